"""Graph, content and research-gate queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import graph, links, rules
from vellumspark.operators.components import strong_components, witness_cycles
from vellumspark.operators.intervals import interval_join
from vellumspark.plans.registry import query, table

# Links --------------------------------------------------------------------

_NAMES = """SELECT 'nations/' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'regions/' || r_regionkey, r_name FROM region
UNION ALL SELECT 'nations/' || n_nationkey, 'nations/' || n_nationkey FROM nation UNION ALL SELECT 'regions/' || n_regionkey, left(n_name, 1) FROM nation UNION ALL SELECT 'nations/' || n_nationkey, left(n_name, 1) FROM nation"""


def _names(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nid, rid = F.concat(F.lit("nations/"), F.col("n_nationkey")), F.concat(F.lit("regions/"), F.col("n_regionkey"))
    initial = F.substring("n_name", 1, 1)
    pairs = [(nation, nid, F.col("n_name")), (region, F.concat(F.lit("regions/"), F.col("r_regionkey")), F.col("r_name")), (nation, nid, nid), (nation, rid, initial), (nation, nid, initial)]
    return rules.report(*(t.select(i.alias("id"), n.alias("name")) for t, i, n in pairs))


@query(f"SELECT name, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM ({_NAMES}) GROUP BY name")
def alias_index(spark, sf_dir):
    return links.alias_index(_names(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


_LINKS = """SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'nations/' ELSE 'regions/' END || 's' || s_suppkey AS source,
CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN n_name || '.md' WHEN 2 THEN 'nations/' || n_nationkey || '.md' WHEN 3 THEN left(n_name, 1) WHEN 4 THEN '' ELSE 'lost/' || n_name END AS note
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _links(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = F.col("s_suppkey") % 6
    note = F.when(m == 0, F.col("n_name")).when(m == 1, F.concat("n_name", F.lit(".md"))).when(m == 2, F.concat(F.lit("nations/"), F.col("n_nationkey"), F.lit(".md")))
    note = note.when(m == 3, F.substring("n_name", 1, 1)).when(m == 4, "").otherwise(F.concat(F.lit("lost/"), F.col("n_name")))
    source = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "nations/").otherwise("regions/"), F.lit("s"), F.col("s_suppkey"))
    return joined.select(source.alias("source"), note.alias("note")).distinct()


@query(f"""WITH idx AS (SELECT name, list_sort(list(DISTINCT id)) AS ids FROM ({_NAMES}) GROUP BY name), l AS ({_LINKS}),
k AS (SELECT *, regexp_replace(note, '\\.md$', '') AS n2 FROM l), k3 AS (SELECT *, CASE WHEN contains(note, '/') THEN NULL ELSE n2 END AS n3 FROM k),
c AS (SELECT k3.*, coalesce(a.ids, b.ids, d.ids) AS ids FROM k3 LEFT JOIN idx a ON a.name = note LEFT JOIN idx b ON b.name = n2 LEFT JOIN idx d ON d.name = n3),
f AS (SELECT *, list_filter(ids, lambda i: regexp_extract(i, '^(.*)/[^/]*$', 1) = regexp_extract(source, '^(.*)/[^/]*$', 1)) AS near FROM c)
SELECT source, note, CASE WHEN note = '' THEN source WHEN len(ids) = 1 THEN ids[1] WHEN len(near) = 1 THEN near[1] END AS target FROM f""")
def link_resolution(spark, sf_dir):
    return links.resolve_links(_links(spark, sf_dir), links.alias_index(_names(spark, sf_dir)))


_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages"


def _hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query(f"SELECT DISTINCT page_id AS source, target, 'href' AS kind FROM ({_HREFS})")
def link_edges(spark, sf_dir):
    edges = _hrefs(spark, sf_dir).select(F.col("page_id").alias("source"), "target", F.lit("href").alias("kind"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("long").alias("line"))
    return links.distinct_edges(edges).select("source", "target", "kind")


@query(f"SELECT target AS ref, array_to_string(list_sort(list(DISTINCT page_id)), ',') AS ids FROM ({_HREFS}) GROUP BY target")
def reverse_index(spark, sf_dir):
    found = links.reverse_index(_hrefs(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("target").alias("ref")))
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("source"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("target"))
    return links.orphans(nodes, edges)


@query("""WITH a AS (SELECT p_brand AS target, lower(p_type) AS a, count(*) AS n FROM part GROUP BY ALL),
l AS (SELECT DISTINCT p_brand AS target, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN p_type || ' x' END AS anchor FROM part)
SELECT l.target, l.anchor, CASE WHEN l.anchor IS NULL THEN 'none' WHEN n IS NULL THEN 'missing_anchor' WHEN n > 1 THEN 'ambiguous_anchor' ELSE 'resolved' END AS state
FROM l LEFT JOIN a ON a.target = l.target AND a.a = lower(l.anchor)""")
def anchor_check(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m = F.col("p_partkey") % 3
    made = part.select(F.col("p_brand").alias("target"), F.when(m == 0, F.upper("p_type")).when(m == 1, F.concat("p_type", F.lit(" x"))).alias("anchor")).distinct()
    return links.check_anchors(made, part.select(F.col("p_brand").alias("id"), F.col("p_type").alias("anchor"))).select("target", "anchor", "state")


# Graph --------------------------------------------------------------------

_TREE = "SELECT s_suppkey // 3 AS parent, s_suppkey AS child FROM supplier WHERE s_suppkey >= 3 UNION SELECT s_suppkey // 5, s_suppkey FROM supplier WHERE s_suppkey >= 5 AND s_suppkey % 2 = 0"
_RING = "SELECT s_suppkey AS source, (s_suppkey * 7 + 3) % 90 AS target FROM supplier"


def _tree(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    one = s.where("s_suppkey >= 3").selectExpr("s_suppkey div 3 as parent", "s_suppkey as child")
    return one.unionByName(s.where("s_suppkey >= 5 and s_suppkey % 2 = 0").selectExpr("s_suppkey div 5 as parent", "s_suppkey as child")).distinct()


def _ring(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as source", "(s_suppkey * 7 + 3) % 90 as target")


@query(f"SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT child FROM ({_TREE}))")
def project_roots(spark, sf_dir):
    return graph.roots(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), _tree(spark, sf_dir))


@query(f"SELECT child, array_to_string(list_sort(list(DISTINCT parent)), ',') AS parents FROM ({_TREE}) GROUP BY child HAVING count(DISTINCT parent) > 1")
def multi_parent(spark, sf_dir):
    return graph.multi_parent(_tree(spark, sf_dir)).withColumn("parents", F.array_join(F.transform("parents", lambda x: x.cast("string")), ","))


@query(f"""WITH RECURSIVE r AS (SELECT source AS start, target AS node FROM ({_RING}) UNION SELECT r.start, e.target FROM r JOIN ({_RING}) e ON r.node = e.source)
SELECT DISTINCT start AS id FROM r WHERE start = node""")
def cycle_flag(spark, sf_dir):
    return graph.on_cycle(_ring(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS (SELECT source, target FROM ({_RING})), r AS (SELECT source AS start, target AS node FROM e UNION SELECT r.start, e.target FROM r JOIN e ON r.node = e.source),
c AS (SELECT a.start AS id, min(a.node) AS cycle FROM r a JOIN r b ON a.start = b.node AND a.node = b.start GROUP BY a.start),
w AS (SELECT DISTINCT cycle, 0 AS position, cycle AS id FROM c UNION ALL SELECT w.cycle, position + 1, e.target FROM w JOIN e ON w.id = e.source WHERE e.target <> w.cycle)
SELECT cycle, position::BIGINT AS position, id FROM w""")
def cycle_witness(spark, sf_dir):
    ring = _ring(spark, sf_dir)
    return witness_cycles(ring, strong_components(ring))


@query(f"""WITH RECURSIVE r AS (SELECT child AS node FROM ({_TREE}) WHERE parent IN (1, 4) UNION SELECT e.child FROM r JOIN ({_TREE}) e ON r.node = e.parent)
SELECT node AS id FROM r WHERE node NOT IN (1, 4)""")
def transitive_impact(spark, sf_dir):
    derived = _tree(spark, sf_dir).select(F.col("child").alias("source"), F.col("parent").alias("target"))
    direct = table(spark, sf_dir, "supplier").where("s_suppkey in (1, 4)").select(F.col("s_suppkey").alias("id"))
    return graph.transitive_impact(derived, direct)


@query(f"SELECT DISTINCT parent AS source, child AS target FROM ({_TREE}) WHERE parent IN (2, 7) OR child IN (2, 7)")
def trace_incident_edges(spark, sf_dir):
    edges = _tree(spark, sf_dir).select(F.col("parent").alias("source"), F.col("child").alias("target"))
    return links.incident(edges, table(spark, sf_dir, "supplier").where("s_suppkey in (2, 7)").select(F.col("s_suppkey").alias("id")))


@query("""WITH refs AS (SELECT p_partkey AS note, replace(p_type, ' ', '/') AS path FROM part), ch AS (SELECT DISTINCT split_part(replace(p_type, ' ', '/'), '/', 1) AS c FROM part WHERE p_size = 1
UNION SELECT DISTINCT replace(p_type, ' ', '/') FROM part WHERE p_size = 2)
SELECT DISTINCT note FROM refs JOIN ch ON path = c OR starts_with(path, c || '/')""")
def source_drift_prefix(spark, sf_dir):
    """A reference drifts if its path or a folder above it changed.  Each path meets
    its own prefixes by equality, so no pair of path and change is tried in vain."""
    part = table(spark, sf_dir, "part").withColumn("path", F.replace("p_type", F.lit(" "), F.lit("/")))
    changed = part.where("p_size = 1").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("prefix")).unionByName(part.where("p_size = 2").select(F.col("path").alias("prefix"))).distinct()
    names = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    return part.select(F.col("p_partkey").alias("note"), F.explode(prefixes).alias("prefix")).join(changed, "prefix", "left_semi").select("note").distinct()


@query("""WITH s AS (SELECT l_orderkey AS note, l_linenumber AS part, l_linenumber * 10 AS lo, l_linenumber * 10 + l_quantity::INT % 15 AS hi FROM lineitem),
e AS (SELECT o_orderkey AS note, (o_orderkey % 60 + 8) AS line FROM orders)
SELECT note, line::BIGINT AS line, part FROM (SELECT e.note, e.line, s.part, row_number() OVER (PARTITION BY e.note, e.line ORDER BY lo, part) AS r FROM e JOIN s ON e.note = s.note AND e.line BETWEEN s.lo AND s.hi) WHERE r = 1""")
def reuse_range_join(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as note", "l_linenumber as part", "l_linenumber * 10 as lo", "l_linenumber * 10 + cast(l_quantity as int) % 15 as hi")
    e = table(spark, sf_dir, "orders").selectExpr("o_orderkey as note", "cast(o_orderkey % 60 + 8 as bigint) as line")
    held = interval_join(e, s, ["note"], "line", "lo", "hi", bucket=16)
    return held.groupBy("note", "line").agg(F.min(F.struct("lo", "part")).alias("m")).select("note", "line", "m.part")


# Content reports ----------------------------------------------------------


@query("""WITH l AS (SELECT source AS folder, doc_id AS doc, trim(unnest(string_split(text, chr(10)))) AS paragraph FROM documents)
SELECT folder, sha256(paragraph) AS paragraph, array_to_string(list_sort(list(DISTINCT doc)), ',') AS owners FROM l WHERE length(paragraph) >= 180 GROUP BY folder, paragraph HAVING count(DISTINCT doc) > 1""")
def canonical_duplication(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("paragraph"))
    found = rules.canonical_duplication(lines)
    return found.select("folder", F.sha2("paragraph", 256).alias("paragraph"), F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"))


@query("""SELECT doc_id AS id, role, chars, threshold FROM (SELECT doc_id, length(trim(text))::BIGINT AS chars,
CASE WHEN source = 'src1' THEN 'solutions' WHEN source = 'src2' THEN 'solution-space' WHEN doc_id % 6 >= 4 THEN 'multi-source-focused' END AS role,
CASE WHEN source = 'src1' THEN 3000 WHEN source = 'src2' THEN 2500 WHEN doc_id % 6 >= 4 THEN 2000 END::BIGINT AS threshold FROM documents) WHERE chars < threshold""")
def density_report(spark, sf_dir):
    name = F.when(F.col("source") == "src1", "solutions.md").when(F.col("source") == "src2", "solution-space.md").otherwise("note.md")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name.alias("name"), (F.col("doc_id") % 6).alias("n_refs"), F.col("text").alias("body"))
    return rules.density(docs)


# Research gate ------------------------------------------------------------


@query("SELECT c_custkey AS entity, coalesce(n, 0)::BIGINT AS facts FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) < 8")
def fact_coverage(spark, sf_dir):
    return rules.fact_coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity")), 8)


@query("""SELECT c_custkey AS entity, axis FROM customer, (SELECT DISTINCT o_orderpriority AS axis FROM orders)
WHERE (c_custkey, axis) NOT IN (SELECT o_custkey, o_orderpriority FROM orders)""")
def axis_coverage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    axes = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("axes"))  # one row: the contract's few axes
    required = table(spark, sf_dir, "customer").crossJoin(F.broadcast(axes)).select(F.col("c_custkey").alias("entity"), F.explode("axes").alias("axis"))
    return rules.axis_coverage(required, orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("axis")).distinct())


@query("""WITH f AS (SELECT l_orderkey || '-' || l_linenumber AS fact_id, CASE WHEN l_partkey % 50 = 0 THEN 'S0' ELSE 'S' || l_suppkey END AS entity, 'S' || l_suppkey AS solution_id, CASE WHEN l_partkey % 40 = 0 THEN -1 WHEN l_partkey % 41 = 0 THEN 1 ELSE l_suppkey END AS source_id,
CASE WHEN l_returnflag = 'R' THEN 'code_demonstrated' ELSE 'author_stated' END AS evidence_type FROM lineitem)
SELECT * FROM (SELECT fact_id, CASE WHEN entity <> solution_id THEN 'FACT_ATTRIBUTION_ERROR: id' WHEN s_suppkey IS NULL THEN 'source not in manifest' WHEN 'S' || s_suppkey <> solution_id THEN 'FACT_ATTRIBUTION_ERROR: source'
WHEN evidence_type = 'code_demonstrated' AND s_nationkey % 2 = 1 THEN 'code_demonstrated without repository' END AS problem FROM f LEFT JOIN supplier ON source_id = s_suppkey) WHERE problem IS NOT NULL""")
def attribution_check(spark, sf_dir):
    own = F.concat(F.lit("S"), F.col("l_suppkey"))
    facts = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.when(F.col("l_partkey") % 50 == 0, "S0").otherwise(own).alias("entity"), own.alias("solution_id"),
        F.when(F.col("l_partkey") % 40 == 0, -1).when(F.col("l_partkey") % 41 == 0, 1).otherwise(F.col("l_suppkey")).alias("source_id"),
        F.when(F.col("l_returnflag") == "R", "code_demonstrated").otherwise("author_stated").alias("evidence_type"),
    )
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("solution_id"), F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("repository"))).otherwise(F.array(F.lit("writeup"))).alias("available"))
    return rules.attribution(facts, sources)


_SUPPORT = """SELECT o_orderkey AS claim_id, o_orderpriority, o_orderstatus, coalesce(n, 0)::BIGINT AS support_count, 3::BIGINT AS eligible_count, round(coalesce(n, 0) / 3::DOUBLE, 6) AS ratio, coalesce(n, 0) = 3 AS covers_all
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1) ON o_orderkey = l_orderkey"""


def _claims(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    support = item.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_list(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("support_fact_ids"))
    status = F.col("o_orderstatus")
    claims = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "All").otherwise("Some"), F.lit(" solutions agree")).alias("statement"),
        F.when(status == "F", "principle").when(status == "O", "alternative").otherwise("mechanism").alias("claim_type"),
        F.when(F.col("o_orderkey") % 4 == 0, "all").when(F.col("o_orderkey") % 4 == 1, "sample").alias("coverage_mode"),
        F.array(*(F.lit(x) for x in "ANR")).alias("eligible_entities"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("counter_fact_ids"),
        F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("within the season").alias("boundary"),
    )
    claims = claims.join(support, "claim_id", "left")
    facts = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_returnflag").alias("solution_id"))
    return claims, facts


@query(f"SELECT claim_id, support_count, eligible_count, ratio, covers_all FROM ({_SUPPORT})")
def claim_support(spark, sf_dir):
    return rules.claim_support(*_claims(spark, sf_dir))


@query(f"""SELECT claim_id FROM ({_SUPPORT}) WHERE (claim_id % 4 = 0 AND NOT covers_all) OR (claim_id % 4 >= 2 AND claim_id % 3 = 0 AND o_orderstatus <> 'O' AND NOT covers_all) OR (claim_id % 4 = 1 AND claim_id % 3 = 0)""")
def universal_coverage(spark, sf_dir):
    claims, facts = _claims(spark, sf_dir)
    return rules.quantifier_failures(claims, rules.claim_support(claims, facts))


@query("SELECT o_orderkey AS claim_id FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 5 = 0 AND o_orderkey % 2 = 0")
def counterexample_boundary(spark, sf_dir):
    return rules.decorative_counterexamples(_claims(spark, sf_dir)[0])


@query("SELECT p_brand AS intervention, lower(p_type) AS variable, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS ids FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def mechanism_duplicate(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("intervention"), F.col("p_type").alias("changed_variable"), F.col("p_partkey").alias("mechanism_id"))
    return rules.duplicate_mechanisms(part).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


_VERDICTS = "SELECT user_id AS fact_id, event_id AS line, CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'AMBIGUOUS' ELSE 'PASS' END AS status FROM events"


def _verdicts(spark, sf_dir):
    m = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("fact_id"), F.col("event_id").alias("line"), F.when(m == 0, "FAIL").when(m == 1, "AMBIGUOUS").otherwise("PASS").alias("status"))


@query(f"SELECT fact_id, arg_max(status, line) AS status FROM ({_VERDICTS}) GROUP BY fact_id")
def verdict_last_wins(spark, sf_dir):
    return rules.last_verdicts(_verdicts(spark, sf_dir), "fact_id")


@query(f"SELECT DISTINCT fact_id FROM ({_VERDICTS}) WHERE status = 'FAIL'")
def verdict_any_fail(spark, sf_dir):
    return rules.failed_verdicts(_verdicts(spark, sf_dir), "fact_id")


@query("SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS excerpt_sha256 FROM documents WHERE len(string_split(text, chr(10))) >= 3")
def evidence_excerpt(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").where(F.size(lines) >= 3).select("doc_id", F.sha2(F.array_join(F.slice(lines, 2, 2), "\n"), 256).alias("excerpt_sha256"))


@query("SELECT DISTINCT o_orderkey AS block, id FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey * 3]) AS id FROM orders) WHERE id NOT IN (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)")
def draft_ref_anti(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"), F.array(F.col("o_custkey"), F.col("o_custkey") * 3).alias("refs"))
    known = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return rules.unknown_references(blocks, *known)


# Journal and provenance ---------------------------------------------------

_STATES = ["system", "user", "assistant"]


@query("""WITH j AS (SELECT conv_id AS run, turn AS seq, role AS state, sha256(conv_id || ':' || turn || ':' || text) AS entry FROM conversations WHERE conv_id % 9 <> 8 OR turn <> 1),
p AS (SELECT *, CASE WHEN run % 10 = 0 AND seq = 1 THEN 'x' ELSE coalesce(lag(entry) OVER w, '') END AS previous FROM j WINDOW w AS (PARTITION BY run ORDER BY seq)),
k AS (SELECT *, lag(entry) OVER w AS before, lag(seq) OVER w AS last, list_position(['system', 'user', 'assistant'], state) AS r, lag(list_position(['system', 'user', 'assistant'], state)) OVER w AS q FROM p WINDOW w AS (PARTITION BY run ORDER BY seq))
SELECT * FROM (SELECT run, seq, CASE WHEN previous IS DISTINCT FROM coalesce(before, '') THEN 'STATE_HISTORY_CHAIN_INVALID' WHEN last IS NOT NULL AND seq <> last + 1 THEN 'STATE_HISTORY_CHAIN_INVALID'
WHEN coalesce(r, 0) = 0 THEN 'STATE_HISTORY_UNKNOWN_STATE' WHEN q IS NOT NULL AND r <> q + 1 THEN 'STATE_TRANSITION_INVALID' END AS problem FROM k) WHERE problem IS NOT NULL""")
def journal_chain(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("seq")
    talks = table(spark, sf_dir, "conversations").where("conv_id % 9 <> 8 or turn <> 1")
    entry = F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")), 256)
    made = talks.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("role").alias("state"), entry.alias("entry"))
    tampered = (F.col("run") % 10 == 0) & (F.col("seq") == 1)
    made = made.withColumn("previous", F.when(tampered, "x").otherwise(F.coalesce(F.lag("entry").over(w), F.lit(""))))
    return rules.journal_issues(made, _STATES)


_ACCEPTED = "SELECT event_id AS run_id, user_id AS output, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS region, ts::VARCHAR AS finalized_at FROM events"


def _accepted(spark, sf_dir):
    region = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("output"), region.alias("region"), F.col("ts").cast("string").alias("finalized_at"))


@query("""WITH e AS (SELECT event_id AS run_id, user_id AS output, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS region, ts AS moment FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY moment, run_id) AS k FROM e),
x AS (SELECT *, max(k) OVER (PARTITION BY output, region) AS last, max(CASE WHEN region IS NULL THEN k END) OVER (PARTITION BY output) AS whole_k, max(CASE WHEN region IS NOT NULL THEN k END) OVER (PARTITION BY output) AS region_k FROM m)
SELECT run_id, output, region FROM x WHERE k = last AND CASE WHEN region IS NULL THEN region_k IS NULL OR k > region_k ELSE whole_k IS NULL OR k > whole_k END""")
def supersession_active(spark, sf_dir):
    return rules.active_acceptances(_accepted(spark, sf_dir)).select("run_id", "output", "region")


@query("SELECT user_id AS output, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY user_id")
def latest_per_output(spark, sf_dir):
    return rules.latest_per_output(_accepted(spark, sf_dir))


@query("SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM (SELECT sha256(n_nationkey || ':' || n_name) AS d FROM nation)")
def dataset_digest(spark, sf_dir):
    return rules.dataset_digest(table(spark, sf_dir, "nation"), F.concat_ws(":", F.col("n_nationkey").cast("string"), F.col("n_name")))


@query("SELECT doc_id::VARCHAR AS name FROM documents WHERE doc_id % 17 = 0 OR doc_id % 23 = 0")
def archive_checksum_compare(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    stored = docs.withColumn("digest", F.when(F.col("doc_id") % 17 == 0, F.lit("edited")).otherwise(F.col("digest")))
    return rules.drifted(docs.where("doc_id % 23 <> 0").select("name", "digest"), stored.select("name", "digest"))


@query("""SELECT l_orderkey AS run, CASE WHEN b = n THEN 'bound' WHEN b > 0 THEN 'mixed' ELSE 'legacy-anchor-only' END AS grade FROM (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)""")
def provenance_grade(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    return counted.select("run", rules.provenance_grade(F.col("b"), F.col("n")).alias("grade"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
