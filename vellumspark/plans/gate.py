"""Queries of the research gate over records made from whole tables: suppliers are facts, parts claims, customers mechanisms."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import gate
from vellumspark.plans.registry import query, table


@query("""WITH m AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 's' || (s_suppkey % 80) END AS source_id, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'n' || s_nationkey END AS solution_id, s_suppkey % 10 = 3 AS none FROM supplier)
SELECT 'manifest' AS kind, solution_id AS subject, 'missing source_id' AS detail FROM m WHERE source_id IS NULL
UNION ALL SELECT 'manifest', source_id, 'duplicate source_id' FROM m WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT 'manifest', coalesce(source_id, ''), 'missing solution_id' FROM m WHERE solution_id = ''
UNION ALL SELECT 'manifest', coalesce(source_id, ''), 'available is empty' FROM m WHERE none""")
def gate_manifest(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sources = s.selectExpr("if(s_suppkey % 9 = 0, null, concat('s', s_suppkey % 80)) as source_id", "if(s_suppkey % 13 = 0, '', concat('n', s_nationkey)) as solution_id", "if(s_suppkey % 10 = 3, array(), array('writeup')) as available")
    return gate.manifest_issues(sources)


@query("""WITH e AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS entity FROM nation), k AS (SELECT DISTINCT 'n' || s_nationkey AS entity FROM supplier WHERE s_nationkey % 2 = 0),
x AS (SELECT 'n' || s_nationkey AS entity, CASE WHEN s_suppkey % 20 = 1 THEN ' ' ELSE 'a' END AS axis FROM supplier)
SELECT 'plan' AS kind, entity AS subject, 'duplicate entity' AS detail FROM e GROUP BY entity HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'plan', entity, 'COVERAGE_ENTITY_NOT_IN_MANIFEST' FROM e WHERE entity NOT IN (SELECT entity FROM k)
UNION ALL SELECT DISTINCT 'plan', entity, 'axes of an unknown entity' FROM x WHERE entity NOT IN (SELECT entity FROM e)
UNION ALL SELECT 'plan', entity, 'blank axis' FROM x WHERE trim(axis) = ''""")
def gate_plan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    entities = table(spark, sf_dir, "nation").selectExpr("if(n_nationkey % 5 = 0, concat('r', n_regionkey), concat('n', n_nationkey)) as entity")
    axes = s.selectExpr("concat('n', s_nationkey) as entity", "if(s_suppkey % 20 = 1, ' ', 'a') as axis")
    return gate.plan_issues(entities, axes, s.where("s_nationkey % 2 = 0").selectExpr("concat('n', s_nationkey) as solution_id"))


_STATUS = "CASE {0} % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'odd' ELSE 'PASS' END"
_FACTS = f"f AS (SELECT s_suppkey AS k, 'F' || s_suppkey AS fact_id, s_suppkey % 11 = 0 AS none, {_STATUS.format('s_suppkey')} AS status FROM supplier)"


def _facts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    facts = s.selectExpr("concat('F', s_suppkey) as fact_id", "s_name as statement", "if(s_suppkey % 2 = 0, array(concat('e', s_suppkey)), array()) as evidence_ids")
    digest = "sha2(if(s_suppkey % 6 = 0, 'other', s_name), 256)"
    evidence = "array(named_struct('evidence_id', concat('e', s_suppkey), 'excerpt_sha256', if(s_suppkey % 8 = 0, 'x', sha2(s_name, 256))))"
    verdicts = s.where("s_suppkey % 11 <> 0").selectExpr("concat('F', s_suppkey) as fact_id", f"{_STATUS.format('s_suppkey')} as status", "s_suppkey as line", f"{digest} as statement_sha256", f"{evidence} as evidence")
    # An earlier verdict, which the last one replaces.
    before = verdicts.withColumns({"status": F.lit("FAIL"), "line": F.lit(-1).cast("long")})
    bindings = s.where("s_suppkey % 2 = 0 and s_suppkey % 10 <> 4").selectExpr("concat('e', s_suppkey) as evidence_id", "sha2(s_name, 256) as excerpt_sha256")
    return facts, verdicts.unionByName(before), bindings


@query(f"""WITH {_FACTS} SELECT 'facts' AS kind, fact_id AS subject, CASE WHEN none THEN 'no verdict' WHEN status = 'odd' THEN 'invalid status' ELSE 'semantic verification FAIL' END AS detail FROM f WHERE none OR status IN ('odd', 'FAIL')
UNION ALL SELECT 'facts', fact_id, 'SEMANTIC_VERDICT_STALE' FROM f WHERE k % 2 = 0 AND NOT none AND status <> 'odd' AND (k % 6 = 0 OR k % 8 = 0 OR k % 10 = 4)""")
def gate_facts(spark, sf_dir):
    return gate.fact_issues(*_facts(spark, sf_dir))


_CLAIMS = f"""c AS (SELECT p_partkey AS k, 'C' || p_partkey AS claim_id, p_partkey % 12 = 0 AS odd, p_partkey % 15 = 0 AS bare, p_partkey % 17 = 0 AS unasked, p_partkey % 19 = 0 AS nobody, p_partkey % 23 = 0 AS none, {_STATUS.format('p_partkey')} AS status FROM part),
s AS (SELECT claim_id, 'F' || x AS fact_id, x FROM (SELECT claim_id, unnest([k % 150, k % 37 + 1]) AS x FROM c WHERE NOT bare))"""


def _claims(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    claims = p.selectExpr(
        "concat('C', p_partkey) as claim_id", "if(p_partkey % 12 = 0, 'guess', 'principle') as claim_type", "p_name as statement", "if(p_partkey % 15 = 0, cast(array() as array<string>), array(concat('F', p_partkey % 150), concat('F', p_partkey % 37 + 1))) as support_fact_ids",
        "if(p_partkey % 17 = 0, null, array(concat('F', p_partkey % 160))) as counter_fact_ids", "if(p_partkey % 19 = 0, cast(array() as array<string>), array('n1')) as eligible_entities",
    )
    own = p.where("p_partkey % 23 <> 0").selectExpr("'claim' as kind", "concat('C', p_partkey) as claim_id", "cast(null as array<string>) as claims", f"{_STATUS.format('p_partkey')} as status", "p_partkey as line")
    against = p.where("p_partkey % 100 = 1").selectExpr("'contradiction' as kind", "concat('C', p_partkey) as claim_id", "array(concat('C', p_partkey), concat('C', p_partkey + 1)) as claims", "if(p_partkey % 200 = 1, 'FAIL', 'PASS') as status", "1000000 + p_partkey as line")
    return claims, own.unionByName(against)


_VERDICT = "CASE WHEN none THEN 'no verdict' WHEN status = 'odd' THEN 'invalid status' ELSE '{0}' END"


@query(f"""WITH {_FACTS}, {_CLAIMS}
SELECT 'claims' AS kind, claim_id AS subject, 'unknown claim_type' AS detail FROM c WHERE odd UNION ALL SELECT 'claims', claim_id, 'support_fact_ids required' FROM c WHERE bare UNION ALL SELECT 'claims', claim_id, 'counter_fact_ids required' FROM c WHERE unasked UNION ALL SELECT 'claims', claim_id, 'eligible_entities required' FROM c WHERE nobody
UNION ALL SELECT DISTINCT 'claims', claim_id, fact_id || ' does not exist' FROM s WHERE fact_id NOT IN (SELECT fact_id FROM f)
UNION ALL SELECT DISTINCT 'claims', claim_id, 'CLAIM_SUPPORT_FAIL ' || fact_id FROM s JOIN f USING (fact_id) WHERE f.none OR f.status <> 'PASS'
UNION ALL SELECT 'claims', claim_id, 'counter F' || (k % 160) || ' does not exist' FROM c WHERE NOT unasked AND 'F' || (k % 160) NOT IN (SELECT fact_id FROM f)
UNION ALL SELECT 'claims', claim_id, {_VERDICT.format('CLAIM_VERIFY_FAIL')} FROM c WHERE none OR status IN ('odd', 'FAIL')
UNION ALL SELECT 'claims', claim_id || ',C' || (k + 1), 'CLAIM_CONTRADICTION' FROM c WHERE k % 200 = 1""")
def gate_claims(spark, sf_dir):
    facts, fact_verdicts, _ = _facts(spark, sf_dir)
    claims, verdicts = _claims(spark, sf_dir)
    return gate.claim_issues(claims, facts, fact_verdicts, verdicts)


@query(f"""WITH {_CLAIMS}, m AS (SELECT c_custkey AS k, 'M' || c_custkey AS mechanism_id, 'C' || (c_custkey % 2100) AS claim_id, c_custkey % 21 = 0 AS free, c_custkey % 31 = 0 AS none, {_STATUS.format('c_custkey')} AS status, c_custkey // 2 AS intervention FROM customer)
SELECT 'mechanisms' AS kind, mechanism_id AS subject, 'missing boundary' AS detail FROM m WHERE free
UNION ALL SELECT 'mechanisms', mechanism_id, claim_id || ' does not exist' FROM m WHERE claim_id NOT IN (SELECT claim_id FROM c)
UNION ALL SELECT 'mechanisms', m.mechanism_id, 'support claim not verified PASS ' || m.claim_id FROM m JOIN c USING (claim_id) WHERE c.none OR c.status <> 'PASS'
UNION ALL SELECT 'mechanisms', string_agg(mechanism_id, ',' ORDER BY mechanism_id), 'MECHANISM_DUPLICATE' FROM m GROUP BY intervention, k % 6 // 3 HAVING count(*) > 1
UNION ALL SELECT 'mechanisms', mechanism_id, {_VERDICT.format('MECHANISM_VERIFY_FAIL')} FROM m WHERE none OR status IN ('odd', 'FAIL')
UNION ALL SELECT 'mechanisms', mechanism_id || ',x', 'MECHANISM_CONFLATION' FROM m WHERE k % 97 = 0""")
def gate_mechanisms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mechanisms = c.selectExpr("concat('M', c_custkey) as mechanism_id", "cast(c_custkey div 2 as string) as intervention", "if(c_custkey % 2 = 0, 'V', 'v') || ((c_custkey % 6) div 3) as changed_variable", "array(concat('C', c_custkey % 2100)) as support_claim_ids", "if(c_custkey % 21 = 0, ' ', 'b') as boundary")
    own = c.where("c_custkey % 31 <> 0").selectExpr("'mechanism' as kind", "concat('M', c_custkey) as mechanism_id", "cast(null as array<string>) as mechanisms", f"{_STATUS.format('c_custkey')} as status", "c_custkey as line")
    mixed = c.where("c_custkey % 97 = 0").selectExpr("'conflation' as kind", "cast(null as string) as mechanism_id", "array(concat('M', c_custkey), 'x') as mechanisms", "'FAIL' as status", "-1L as line")
    claims, claim_verdicts = _claims(spark, sf_dir)
    return gate.mechanism_issues(mechanisms, claims, claim_verdicts, own.unionByName(mixed))


@query("""SELECT 'gate' AS kind, n_name AS subject, 'drift before gate' AS detail FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 4 = 0 UNION ALL SELECT 'gate', '', 'unresolved contradictions remain' FROM (SELECT count(*) AS n FROM part WHERE p_partkey % 200 = 1) WHERE n > 0""")
def gate_open(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    current = n.where("n_nationkey % 8 <> 0").selectExpr("n_name as name", "if(n_nationkey % 4 = 0, 'new', sha2(n_name, 256)) as digest")
    stored = n.selectExpr("n_name as name", "if(n_nationkey % 6 = 5, null, sha2(n_name, 256)) as digest")
    return gate.gate_issues(current, stored, _claims(spark, sf_dir)[1])
