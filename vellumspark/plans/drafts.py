"""Drafts made of all documents: a reference marker before every third line of the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import drafts
from vellumspark.plans.registry import query, table

#: Both engines read these: i is the document's id, k the number of a block.
_REFS = ["concat('C-', (i + k) % 40)", "concat('C-', (i * 3 + k) % 55)", "concat('F-', (i + k * 7) % 150)"]
_TAIL = "CASE WHEN (i + k) % 4 = 0 THEN concat(' Only ', (i + k) % 5, ' methods and two solutions') WHEN (i + k) % 4 = 1 THEN ' every one' ELSE '' END"
_MODE = "CASE s_suppkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'exact_count' ELSE 'some' END"
_TEXT = "CASE WHEN i % 11 = 0 THEN concat('---\nx: y\n---\n## ', CASE WHEN i % 2 = 0 THEN 'evidence MAP' ELSE 'Evidence Maps' END, '\nlabel one\n', t) WHEN i % 13 = 0 THEN concat('see repo://a\n', t) ELSE t END"


def _drafts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    bound = lambda sql: "transform(array(k_), k -> " + sql + ")[0]"
    marker = "concat('<!-- KOS:refs=', " + ", ', ', ".join(bound(r) for r in _REFS) + ", ' -->\n')"
    line = f"transform(lines, (x, n) -> transform(array(CAST(n div 3 AS BIGINT)), k_ -> concat(CASE WHEN n % 3 = 0 THEN {marker} ELSE '' END, x, CASE WHEN n % 3 = 0 THEN {bound(_TAIL)} ELSE '' END))[0])"
    return docs.select(F.col("i").alias("draft"), F.col("i"), F.expr(f"array_join({line}, '\n')").alias("t")).select("draft", F.expr(_TEXT.replace("\n", "\\n")).alias("text"))


def _known(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    claims = supplier.select(F.concat(F.lit("C-"), "s_suppkey").alias("claim_id"), F.expr(_MODE).alias("coverage_mode"), F.expr("s_suppkey % 5").alias("support_count"), F.expr("s_suppkey % 4").alias("eligible_count"))
    return drafts.artifacts(part.where("p_partkey % 3 > 0").select(F.concat(F.lit("F-"), "p_partkey").alias("fact_id")), claims, supplier.select(F.lit("M-1").alias("mechanism_id")))


_SQL = f"""d AS (SELECT doc_id AS i, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
b AS (SELECT i, k, array_to_string(lines[3 * k + 1:3 * k + 1], '') || {_TAIL} || coalesce(chr(10) || nullif(array_to_string(lines[3 * k + 2:3 * k + 3], chr(10)), ''), '') AS text, [{", ".join(_REFS)}] AS refs FROM (SELECT *, unnest(range(0, (len(lines) + 2) // 3)) AS k FROM d)),
c AS (SELECT concat('C-', s_suppkey) AS ref, {_MODE} AS mode, s_suppkey % 5 AS support, s_suppkey % 4 AS eligible FROM supplier),
known AS (SELECT ref FROM c UNION SELECT concat('F-', p_partkey) FROM part WHERE p_partkey % 3 > 0),
r AS (SELECT i, k, unnest(list_distinct(refs)) AS ref FROM b),
p AS (SELECT i, k, string_agg(ref, ',' ORDER BY ref) FILTER (ref NOT IN (FROM known)) AS unknown, coalesce(list(DISTINCT support) FILTER (mode = 'exact_count'), []) AS exact, coalesce(bool_or(mode = 'all' AND support = eligible), false) AS covered FROM r LEFT JOIN c USING (ref) GROUP BY i, k),
u AS (SELECT i, k, list_distinct(list_transform(regexp_extract_all(lower(text), '\\b([0-9]+|two)\\s+(?:solutions?|approaches?|entities|methods?|adopters?)\\b', 1), lambda n: CASE n WHEN 'two' THEN 2 ELSE n::BIGINT END)) AS needed FROM b WHERE regexp_matches(text, '(?i)\\b(?:all|every|none|only|never|both)\\b')),
s AS (SELECT i, k, p.unknown, u.needed, p.exact, p.covered, u.i IS NOT NULL AND NOT CASE WHEN len(u.needed) > 0 THEN len(list_intersect(u.needed, p.exact)) = len(u.needed) ELSE p.covered END AS open FROM p LEFT JOIN u USING (i, k))"""


@query(f"WITH {_SQL} SELECT i AS draft, k AS block, unknown, array_to_string(list_sort(needed), ',') AS needed, array_to_string(list_sort(exact), ',') AS exact, covered FROM s")
def draft_proofs(spark, sf_dir):
    found = drafts.block_proofs(drafts.traced_blocks(_drafts(spark, sf_dir)), _known(spark, sf_dir))
    return found.select("draft", "block", F.nullif(F.array_join("unknown", ","), F.lit("")).alias("unknown"), F.array_join(F.array_sort("needed"), ",").alias("needed"), F.array_join("exact", ",").alias("exact"), "covered")


_WHOLE = """SELECT i, NULL, 'DOCUMENT_COMPLETENESS_FAIL', 'section Evidence Map' FROM d WHERE NOT (i % 11 = 0 AND i % 2 = 0)
UNION ALL SELECT i, NULL, 'DOCUMENT_COMPLETENESS_FAIL', 'label label one' FROM d WHERE i % 11 <> 0
UNION ALL SELECT i, NULL, 'MACHINE_PATH_LEAK', '' FROM d WHERE i % 13 = 0 AND i % 11 <> 0"""


@query(f"WITH {_SQL} SELECT i AS draft, k AS block, 'UNKNOWN_REFS' AS code, unknown AS detail FROM s WHERE unknown IS NOT NULL UNION ALL SELECT i, k, 'UNIVERSAL_WORDING_UNVERIFIED', array_to_string(list_sort(needed), ',') FROM s WHERE open UNION ALL {_WHOLE}")
def draft_verify(spark, sf_dir):
    made = _drafts(spark, sf_dir)
    contracts = made.select("draft", F.array(F.lit("Evidence Map")).alias("sections"), F.array(F.lit("label one")).alias("labels"), F.lit(1).alias("min_chars"))
    found = drafts.verify_drafts(made, _known(spark, sf_dir), contracts)
    numbers = F.array_join(F.transform(F.array_sort(F.transform(F.split("detail", ","), lambda x: x.try_cast("long"))), lambda x: x.cast("string")), ",")
    return found.withColumn("detail", F.when(F.col("code") == "UNIVERSAL_WORDING_UNVERIFIED", numbers).otherwise(F.col("detail")))
