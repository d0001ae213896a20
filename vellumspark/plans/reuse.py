"""Declared reuse over a vault of all documents: the whole text stands before, inside or behind a section of applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import knowledge_graph, reuse
from vellumspark.plans.registry import query, table
from vellumspark.sources import vault

_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'project-doc' WHEN 2 THEN 'learning' ELSE 'paper' END"
_HEAD = "CASE doc_id % 5 WHEN 0 THEN '## Applications' WHEN 1 THEN '## APPLICATION records ##' WHEN 2 THEN '## 复用记录' ELSE '## Notes' END"
_LINK = "concat('- see [[N', doc_id * 3 % 1200, '|it]] and ![[N', doc_id + 1, ']]')"
#: Lines around the text; learning notes are met under a heading, under a heading of that, and outside.
_LINES = ["'---'", f"concat('type: ', {_TYPE})", "'---'", f"CASE WHEN doc_id % 3 = 0 THEN {_HEAD} ELSE '# Start' END", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END", f"CASE WHEN doc_id % 3 = 1 THEN {_HEAD} ELSE 'plain' END", _LINK,
          "CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END", "CASE WHEN doc_id % 2 = 0 THEN '### Detail' ELSE '## Other' END", _LINK]

_SQL = f"""n AS (SELECT doc_id, text, 'vault/N' || doc_id AS id, {_TYPE} AS type, doc_id % 5 < 3 AS recorded, (length(text) - length(replace(text, chr(10), ''))) AS feeds FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
l AS (SELECT n.id, n.doc_id, n.text, x.line, x.first, {_LINK} AS context, x.inner, CASE WHEN n.doc_id % 3 = 2 THEN 0 ELSE 1 END AS held, n.recorded, n.type, n.feeds FROM n, LATERAL (SELECT 7 + CASE WHEN n.doc_id % 3 = 0 THEN 0 ELSE n.feeds END AS line, true AS first, false AS inner UNION ALL SELECT 10 + n.feeds, false, n.doc_id % 2 = 0) x),
u AS (SELECT l.*, t.id AS target FROM l, LATERAL (SELECT l.doc_id * 3 % 1200 AS k UNION SELECT l.doc_id + 1) x JOIN n t ON t.doc_id = x.k WHERE l.type IN ('project', 'project-doc') AND t.type = 'learning' AND l.recorded AND l.held = 1 AND (l.first OR l.inner))"""


@query(f"""WITH {_SQL} SELECT id AS project_note, target AS learning, line::BIGINT AS line, context,
sha256(regexp_replace(CASE WHEN NOT first THEN '### Detail' || chr(10) || context WHEN doc_id % 3 = 0 THEN {_HEAD} || chr(10) || chr(10) || 'plain' || chr(10) || context || chr(10) || text ELSE {_HEAD} || chr(10) || context || chr(10) END, '\\s+$', '')) AS record, 'declared-use-not-validated-effect' AS verification
FROM u""")
def reuse_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    files = docs.select(F.concat(F.lit("vault/N"), "doc_id", F.lit(".md")).alias("path"), F.concat_ws("\n", *map(F.expr, _LINES)).alias("text"))
    notes = vault.notes(files)
    found = reuse.reuse_report(knowledge_graph.build_graph(notes).edges, notes, vault.sections(notes))
    return found.withColumn("line", F.col("line").cast("long")).withColumn("record", F.sha2("record", 256))
