"""Evidence bundles made of all documents: one bundle each, its final output the whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import bundles
from vellumspark.plans.registry import query, table

#: The fault of each bundle, the first that holds; both engines read this.
_FAULTS = {
    "pending": "i % 23 = 5",
    "uncommitted or misidentified archive": "i % 29 = 6 OR i % 31 = 7",
    "missing archive manifest": "i % 53 = 12",
    "incomplete accepted evidence bundle": "i % 37 = 8",
    "invalid archive member": "i % 41 = 9",
    "artifact checksum mismatch: final-output.md": "i % 17 = 3",
    "artifact checksum mismatch: gate.json": "i % 19 = 4",
    "final output checksum mismatch": "i % 43 = 10",
    "archive acceptance does not match committed run": "i % 47 = 11",
}
_BUNDLE = "CASE WHEN i % 23 = 5 THEN concat('.pending-run-', i) ELSE concat('run-', i) END"
_FINAL = "concat('2024-0', 1 + i % 9, '-01')"
_OUTPUT = "concat('vault/P', CAST(floor(i / 4) AS BIGINT), '.md')"
_REGION = "CASE WHEN i % 5 = 2 THEN 'part' END"


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    small = {"facts.jsonl": "{}", "claims.jsonl": "{}", "mechanisms.jsonl": "", "draft-trace.json": "{}", "gate.json": "{}"}
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    run = F.to_json(F.struct(F.lit("COMMITTED").alias("state"), F.struct(F.expr(f"CASE WHEN i % 47 = 11 THEN 'else' ELSE {_OUTPUT} END").alias("output"), F.expr(_FINAL).alias("finalized_at")).alias("finalization")))
    every = {bundles.OUTPUT: F.col("text"), bundles.RUN: run, **{n: F.lit(t) for n, t in small.items()}}
    manifest = F.map_from_arrays(F.array(*(F.lit(n) for n in every)), F.array(*(sha(c) for c in every.values())))
    manifest = F.map_filter(manifest, lambda k, v: ~(((k == "gate.json") & F.expr("i % 37 = 8")) | ((k == bundles.OUTPUT) & F.expr("i % 53 = 12"))))
    manifest = F.when(F.expr("i % 41 = 9"), F.map_concat(manifest, F.create_map(F.lit("../x"), F.lit("0")))).otherwise(manifest)
    state = F.expr("CASE WHEN i % 29 = 6 THEN 'FINAL_VERIFIED' ELSE 'COMMITTED' END")
    name = F.expr("concat('run-', CASE WHEN i % 31 = 7 THEN i + 1 ELSE i END)")
    output = F.expr("CASE WHEN i % 43 = 10 THEN 'other' ELSE '' END")
    accepted = F.to_json(F.struct(name.alias("run_id"), state.alias("state"), F.expr(_OUTPUT).alias("output"), F.concat(sha(F.col("text")), output).alias("output_sha256"), F.expr(_REGION).alias("region"), F.expr(_FINAL).alias("finalized_at"), manifest.alias("files")))
    members = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in {**every, bundles.ACCEPTANCE: accepted}.items()))
    held = docs.select("i", F.expr(_BUNDLE).alias("bundle"), F.explode(members).alias("m")).select("i", "bundle", "m.*")
    held = held.where("not (name = 'gate.json' and i % 19 = 4)").withColumn("content", F.when(F.expr("name = 'final-output.md' and i % 17 = 3"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    json = F.when(F.col("name").isin(bundles.ACCEPTANCE, bundles.RUN), F.col("content"))
    return held.select("bundle", "name", sha(F.col("content")).alias("sha256"), json.alias("content"))


_DETAIL = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in _FAULTS.items()) + " END"
_SQL = f"d AS (SELECT doc_id AS i, coalesce(text, '') AS text FROM documents), s AS (SELECT *, {_BUNDLE} AS bundle, {_DETAIL} AS fault FROM d)"


@query(f"WITH {_SQL} SELECT CASE fault WHEN 'pending' THEN 'PROVENANCE_PENDING' ELSE 'PROVENANCE_ARCHIVE_DRIFT' END AS kind, bundle, nullif(fault, 'pending') AS detail FROM s WHERE fault IS NOT NULL")
def bundle_issues(spark, sf_dir):
    return bundles.bundle_issues(bundles.bundle_states(_files(spark, sf_dir)))


@query(f"""WITH {_SQL} SELECT 'run-' || i AS run_id, {_OUTPUT} AS output, sha256(text) AS output_sha256, {_REGION} AS region, {_FINAL} AS finalized_at FROM s WHERE fault IS NULL
UNION ALL SELECT 'run-' || i, 'legacy', 'x', NULL, '2023' FROM s WHERE fault IS NOT NULL AND i % 2 = 0""")
def finalization_entries(spark, sf_dir):
    """Every run has a legacy entry, which counts where its bundle is no good and the run is still there."""
    docs = table(spark, sf_dir, "documents")
    legacy = docs.select(F.concat(F.lit("run-"), "doc_id").alias("run_id"), F.lit("legacy").alias("output"), F.lit("x").alias("output_sha256"), *(F.lit(None).cast("string").alias(c) for c in ("region", "region_sha256")), F.lit("2023").alias("finalized_at"))
    found = bundles.finalization_entries(bundles.verified(bundles.bundle_states(_files(spark, sf_dir))), legacy, legacy.where("substring(run_id, 5) % 2 = 0"))
    return found.drop("region_sha256")


@query(f"""WITH {_SQL}, r AS (SELECT *, {_OUTPUT} AS output, {_REGION} AS region, {_FINAL} AS at FROM s WHERE fault IS NULL),
l AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.output = b.output AND (a.region IS NOT DISTINCT FROM b.region OR a.region IS NULL OR b.region IS NULL) AND (b.at, 'run-' || b.i) > (a.at, 'run-' || a.i)))
SELECT CASE WHEN region IS NOT NULL OR t.i IS NULL THEN 'FINALIZATION_OUTPUT_MISSING_OR_INVALID' ELSE 'FINALIZATION_HASH_DRIFT' END AS kind, 'run-' || l.i AS run, output, region
FROM l LEFT JOIN d t ON output = 'vault/P' || t.i || '.md' AND t.i % 7 <> 0 WHERE region IS NOT NULL OR t.i IS NULL OR t.text <> l.text""")
def archive_audit(spark, sf_dir):
    outputs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("vault/P"), "doc_id", F.lit(".md")).alias("output"), F.coalesce("text", F.lit("")).alias("text"))
    return bundles.archive_audit(bundles.verified(bundles.bundle_states(_files(spark, sf_dir))), outputs)
