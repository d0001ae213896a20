"""Research runs of all documents: each line of a text is a fact, every three facts make a claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import research_drift as drift
from vellumspark.plans.registry import query, table
from vellumspark.tables import delete_path, new_path, written

#: Both engines read these: lines that are edited later, and lines that are gone.
_EDITED, _GONE = "i % 7 = 2 AND k % 4 = 1", "i % 11 = 3 AND k = 2"
_STATE = "CASE i % 5 WHEN 0 THEN 'FACTS_READY' WHEN 1 THEN 'FACTS_FROZEN' WHEN 2 THEN 'CLAIMS_VERIFIED' ELSE 'COMMITTED' END"


def _run():
    return F.concat(F.lit("run-"), "i").alias("run_id")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))


def _claims(spark, sf_dir):
    """Made text by text, without a shuffle."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    ids = F.transform(F.sequence(F.col("c") * 3, F.least(F.col("c") * 3 + 2, F.col("n") - 1)), lambda k: F.concat(F.lit("F-"), k.cast("string")))
    counted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), n.alias("n"))
    claims = counted.select("i", "n", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div 3 as int)"))).alias("c"))
    claim = F.to_json(F.struct(F.concat(F.lit("C-"), "c").alias("claim_id"), F.array_sort(ids).alias("support_fact_ids")))
    return claims.select(_run(), F.lit("claims").alias("artifact"), F.col("c").cast("long").alias("line_no"), claim.alias("record"))


def _artifacts(lines, claims):
    fact = F.to_json(F.struct(F.concat(F.lit("F-"), "k").alias("fact_id"), F.col("line").alias("statement")))
    facts = lines.select(_run(), F.lit("facts").alias("artifact"), F.col("k").cast("long").alias("line_no"), fact.alias("record"))
    return facts.unionByName(claims)


def _two(spark, sf_dir):
    lines, claims = _lines(spark, sf_dir), _claims(spark, sf_dir)
    later = lines.where(f"not ({_GONE})").withColumn("line", F.when(F.expr(_EDITED), F.concat("line", F.lit("."))).otherwise(F.col("line")))
    return _artifacts(lines, claims), _artifacts(later, claims)


_SQL = f"l AS (SELECT doc_id AS i, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents), h AS (SELECT *, CASE WHEN {_GONE} THEN 'removed' WHEN {_EDITED} THEN 'changed' END AS change FROM l)"


@query(f"WITH {_SQL} SELECT 'run-' || i AS run_id, 'C-' || k // 3 AS claim, 'F-' || k AS fact, change FROM h WHERE change IS NOT NULL")
def touched_claims(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    trees = [drift.build_tree(a, new_path(spark, "digest-tree")) for a in (before, after)]
    found = written(drift.touched_claims(drift.changed_records(*trees, "facts"), drift.read_records(after)), "touched-claims")
    for tree in trees:
        delete_path(spark, tree.path)
    return found


@query(f"""WITH {_SQL}, r AS (SELECT i, bool_or(change IS NOT NULL) AS facts, {_STATE} AS state FROM h GROUP BY i)
SELECT 'FACT_MATRIX_STALE' AS kind, 'run-' || i AS run_id, 'facts' AS detail FROM r WHERE facts AND state <> 'FACTS_READY'
UNION ALL SELECT 'CLAIM_MATRIX_STALE', 'run-' || i, 'claims' FROM r WHERE i % 13 = 1 AND state IN ('CLAIMS_VERIFIED', 'COMMITTED')
UNION ALL SELECT 'COVERAGE_PLAN_STALE', 'run-' || i, 'coverage_plan' FROM r WHERE i % 17 = 1 AND state <> 'FACTS_READY'
UNION ALL SELECT 'CLAIM_SUPPORT_DRIFT', 'run-' || i, 'C-' || k // 3 || ': F-' || k FROM h WHERE change = 'removed' AND {_STATE} IN ('CLAIMS_VERIFIED', 'COMMITTED')""")
def research_issues(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    i = F.substring("run_id", F.lit(5), F.lit(20)).cast("long")
    digests = drift.artifact_digests(drift.read_records(before))  # what a run's record holds
    recorded = digests.groupBy("run_id").agg(*(F.max(F.when(F.col("artifact") == a, F.col("digest"))).alias(a) for a in ("facts", "claims")))
    runs = recorded.withColumn("i", i).select("run_id", F.expr(_STATE).alias("state"), F.expr("CASE WHEN i % 17 = 1 THEN 'x' WHEN i % 17 = 2 THEN sha2('{}', 256) END").alias("coverage_plan_sha256"), F.col("facts").alias("facts_sha256"), F.expr("CASE WHEN i % 13 = 1 THEN 'y' ELSE claims END").alias("claims_sha256"), F.lit("z").alias("mechanisms_sha256"))
    return drift.research_issues(runs, after)


@query("""WITH e AS (SELECT doc_id AS place, 'run-' || doc_id AS run_id, 'P' || doc_id % 300 AS output, sha256(coalesce(text, '')) AS digest, doc_id // 500 AS since FROM documents),
a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY output ORDER BY since DESC, place DESC) = 1)
SELECT CASE WHEN d.doc_id IS NULL THEN 'FINALIZATION_OUTPUT_MISSING' ELSE 'UNVERIFIED_GENERATED_UPDATE' END AS kind, run_id, output FROM a LEFT JOIN documents d ON output = 'P' || d.doc_id AND d.doc_id % 6 <> 5 WHERE place % 4 <> 0 AND digest IS DISTINCT FROM sha256(coalesce(d.text, CASE WHEN d.doc_id IS NOT NULL THEN '' END))""")
def output_issues(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    entries = docs.select(F.col("doc_id").alias("place"), F.concat(F.lit("run-"), "doc_id").alias("run_id"), F.concat(F.lit("P"), F.col("doc_id") % 300).alias("output"), F.sha2("text", 256).alias("output_sha256"), F.expr("lpad(cast(doc_id div 500 as string), 9, '0')").alias("finalized_at"))
    outputs = docs.where("doc_id % 6 <> 5").select(F.concat(F.lit("P"), "doc_id").alias("output"), "text")
    return drift.output_issues(entries, entries.where("place % 4 = 0"), outputs)
