"""Claim ledgers of all documents: each line of a text is a claim of a run of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import ledger
from vellumspark.plans.registry import query, table


def _claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    # Written with blanks and in another order than the canonical form has.
    text = F.substring(F.to_json(F.struct(F.col("line").alias("text"))), F.lit(2), F.lit(1 << 30))
    record = F.concat(F.lit('{ "durable": '), F.when(F.expr("(i + k) % 3 > 0"), "true").otherwise('"true"'), F.lit(', "claim_id": "C-'), 1000 - F.col("k"), F.lit('", '), text)
    return docs.select("i", F.concat(F.lit("run-"), "i").alias("run_id"), F.col("k").cast("long").alias("line_no"), record.alias("record"))


_SQL = """d AS (SELECT doc_id AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
c AS (SELECT *, to_json(line)::VARCHAR AS quoted, (i + k) % 3 > 0 AS durable, 'C-' || (1000 - k) AS claim FROM d),
j AS (SELECT *, '{"claim_id":"' || claim || '","durable":' || CASE WHEN durable THEN 'true' ELSE '"true"' END || ',"text":' || quoted || '}' AS record FROM c),
g AS (SELECT i, count(*) FILTER (durable) AS n, sha256(coalesce(string_agg(record, chr(10) ORDER BY k) FILTER (durable), '')) AS durable, sha256(string_agg(record, chr(10) ORDER BY claim, k)) AS source FROM j GROUP BY i)"""


@query(f"""WITH {_SQL} SELECT 'run-' || i AS run_id, unnest(range(1, 6)) AS line_no, sha256(unnest(['schema_version: 1', 'generated_from_run: run-' || i, 'durable_claims_sha256: ' || durable, 'claims_source_sha256: ' || source, 'claims:'])) AS line FROM g WHERE n > 0
UNION ALL SELECT 'run-' || i, 5 + row_number() OVER (PARTITION BY i ORDER BY k), sha256('  - ' || record) FROM j WHERE durable""")
def ledger_export(spark, sf_dir):
    return ledger.export_ledgers(_claims(spark, sf_dir).drop("i")).withColumn("line", F.sha2("line", 256))


@query(f"""WITH {_SQL} SELECT CASE WHEN i % 17 = 3 OR i % 19 <> 4 AND i % 13 = 6 THEN 'CLAIM_LEDGER_STALE' ELSE 'CLAIM_LEDGER_DRIFT' END AS kind, 'v/P' || i || '/claims.yaml' AS ledger, CASE WHEN i % 17 <> 3 AND i % 19 <> 4 AND i % 13 = 6 THEN 'run-' || i END AS run, CASE WHEN i % 17 <> 3 AND i % 19 <> 4 AND i % 13 = 6 THEN 'run-later' END AS active_run
FROM g WHERE n > 0 AND (i % 17 = 3 OR i % 19 = 4 OR i % 13 = 6 OR i % 11 = 5 OR i % 7 = 2)""")
def ledger_issues(spark, sf_dir):
    """Exported ledgers, some without their run (17), of runs not committed (19), superseded (13), edited (11), or with claims that changed since (7)."""
    claims = _claims(spark, sf_dir)
    i = F.substring("run_id", F.lit(5), F.lit(20)).cast("long")
    lines = ledger.export_ledgers(claims.drop("i")).withColumn("i", i).where("not (i % 17 = 3 and line_no = 2)")
    edited = F.when(F.expr("i % 11 = 5 and line_no = 6"), F.replace("line", F.lit('"text":"'), F.lit('"text":"!'))).otherwise(F.col("line"))
    files = lines.select(F.concat(F.lit("v/P"), "i", F.lit("/claims.yaml")).alias("ledger"), "line_no", edited.alias("line"))
    runs = table(spark, sf_dir, "documents").select(F.concat(F.lit("run-"), "doc_id").alias("run_id"), F.expr("CASE WHEN doc_id % 19 = 4 THEN 'DRAFT_READY' ELSE 'COMMITTED' END").alias("state"))
    entries = runs.select("run_id", F.concat(F.lit("v/P"), F.substring("run_id", F.lit(5), F.lit(20)), F.lit("/solution-space.md")).alias("output"), F.lit("2024").alias("finalized_at"))
    later = entries.where("substring(run_id, 5) % 13 = 6").select(F.lit("run-later").alias("run_id"), "output", F.lit("2025").alias("finalized_at"))
    now = claims.withColumn("record", F.when(F.expr("i % 7 = 2 and line_no = 0"), F.replace("record", F.lit('"C-'), F.lit('"D-'))).otherwise(F.col("record"))).where("not (i % 7 = 2 and line_no = 1)")
    return ledger.ledger_issues(files, runs, now.drop("i"), entries.unionByName(later))
