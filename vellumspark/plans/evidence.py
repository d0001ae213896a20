"""Evidence bound to lines of all documents: each whole text is a source file."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import evidence
from vellumspark.plans.registry import query, table

_PATH = "CASE WHEN doc_id % 10 = 1 THEN concat('src/./x/../N', doc_id, '.txt') WHEN doc_id % 23 = 2 THEN concat('src/../N', doc_id, '.txt') WHEN doc_id % 29 = 3 THEN concat('src/lost', doc_id, '.txt') ELSE concat('src/N', doc_id, '.txt') END"
_SOURCE = "CASE WHEN doc_id % 31 = 4 THEN 'nowhere' ELSE concat('s', doc_id % 3) END"
_LOW, _HIGH = "1 + doc_id % 4 - CASE WHEN doc_id % 37 = 5 THEN 9 ELSE 0 END", "1 + doc_id % 4 + doc_id % 5 - CASE WHEN doc_id % 41 = 6 THEN 20 ELSE 0 END"
_KIND = "CASE WHEN doc_id % 43 = 7 THEN 'page' ELSE 'file_lines' END"
_REVISION = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'abcdef' ELSE 'ab' END"
_TYPE = "CASE WHEN doc_id % 2 = 0 THEN 'code_demonstrated' ELSE 'author_stated' END"
#: s0 and s1 are repositories at abcd, s2 is a paper without a revision.
_SOURCES = "SELECT concat('s', k) AS source_id, CASE WHEN k < 2 THEN 'repository' ELSE 'paper' END AS kind, 'src' AS root, CASE WHEN k < 2 THEN 'abcd' ELSE '' END AS revision FROM range(3) t(k)"

_SQL = f"""d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, {_LOW} AS low, {_HIGH} AS high, {_KIND} AS kind, {_SOURCE} AS source, {_REVISION} AS rev, {_TYPE} AS type FROM documents),
r AS (SELECT *, CASE WHEN kind <> 'file_lines' THEN 'evidence anchor must be file_lines' WHEN source = 'nowhere' THEN 'EVIDENCE_SOURCE_MISMATCH: unknown source' WHEN type = 'code_demonstrated' AND source = 's2' THEN 'CODE_DEMONSTRATED_WRONG_SOURCE_KIND' WHEN doc_id % 10 <> 1 AND doc_id % 23 = 2 THEN 'EVIDENCE_SOURCE_MISMATCH: path' WHEN doc_id % 10 <> 1 AND doc_id % 29 = 3 THEN 'evidence file missing' WHEN low < 1 OR high < low OR high > len(lines) THEN 'invalid evidence line range' END AS reason FROM d),
o AS (SELECT *, source IN ('s0', 's1') AND rev <> '' AND NOT starts_with('abcd', rev) AND (reason IS NULL OR reason IN ('EVIDENCE_SOURCE_MISMATCH: path', 'evidence file missing', 'invalid evidence line range')) AS other FROM r)"""


def _bound(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.concat(F.lit("src/N"), "doc_id", F.lit(".txt")).alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line")).select("file", (F.col("k") + 1).cast("long").alias("number"), "line")
    anchor = F.struct(F.expr(_KIND).alias("kind"), F.expr(_PATH).alias("path"), F.expr(_LOW).alias("start_line"), F.expr(_HIGH).alias("end_line"), F.expr(_REVISION).alias("revision"))
    facts = docs.select(F.concat(F.lit("F-"), "doc_id").alias("fact_id"), F.lit("S").alias("solution_id"), F.expr(_SOURCE).alias("source_id"), F.expr(_TYPE).alias("evidence_type"), F.array(F.concat(F.lit("E-"), "doc_id")).alias("evidence_ids"), anchor.alias("anchor"))
    return evidence.bind_evidence(facts, spark.sql(_SOURCES), lines)


@query(f"WITH {_SQL} SELECT 'E-' || doc_id AS evidence_id, source AS source_id, 'src/N' || doc_id || '.txt' AS file, low::BIGINT AS start_line, high::BIGINT AS end_line, coalesce(nullif(rev, ''), CASE WHEN source <> 's2' THEN 'abcd' END) AS source_revision, sha256(array_to_string(lines[low:high], chr(10))) AS excerpt_sha256, sha256(array_to_string(lines, chr(10))) AS source_file_sha256 FROM o WHERE reason IS NULL")
def evidence_bindings(spark, sf_dir):
    return _bound(spark, sf_dir)[0].drop("fact_id", "solution_id", "excerpt")


@query(f"WITH {_SQL} SELECT 'F-' || doc_id AS fact_id, reason AS error FROM o WHERE reason IS NOT NULL UNION ALL SELECT 'F-' || doc_id, 'EVIDENCE_SOURCE_MISMATCH: revision' FROM o WHERE other")
def evidence_errors(spark, sf_dir):
    return _bound(spark, sf_dir)[1].drop("evidence_id")
