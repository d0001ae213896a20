"""Source drift and incremental states of a vault made of all documents and their whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import maintain
from vellumspark.plans.registry import query, table
from vellumspark.tables import delete_path, new_path, written

_REPO = "concat('repo://r', doc_id % 6, '@abc/dir', doc_id % 4, '/file', doc_id % 10, '.py', CASE WHEN doc_id % 3 = 0 THEN '#L3' WHEN doc_id % 3 = 1 THEN '::name' ELSE '' END)"
_LINES = ["'---'", "'type: learning'", f"concat('source_refs: [\"', {_REPO}, '\", source:s', doc_id % 9, ']')", "CASE WHEN doc_id % 2 = 1 THEN concat('derived_from: [\"[[N', CAST(floor(doc_id / 3) AS BIGINT), ']]\"]') ELSE 'x: y' END", "'---'", "coalesce(text, '')"]


def _files(docs):
    return docs.select(F.concat(F.lit("vault/N"), "doc_id", F.lit(".md")).alias("path"), F.concat_ws("\n", *map(F.expr, _LINES)).alias("text"))


#: Sources s0 to s5 of the repositories r0 to r5; the even ones drift: a folder of r0, a file of r2, all of r4.
_SOURCES = "SELECT concat('s', k) AS source_id, concat('repos/r', k) AS path, 'abc' AS ingested, CASE WHEN k = 5 THEN NULL WHEN k % 2 = 0 THEN 'def' ELSE 'abc' END AS current FROM range(6) t(k)"
_CHANGED = "SELECT * FROM VALUES ('s0', 'dir1/'), ('s0', 'other'), ('s1', 'dir1'), ('s2', 'dir2/file2.py'), ('s2', 'dir0') t(source_id, file)"


@query("""WITH RECURSIVE n AS (SELECT doc_id, doc_id % 6 AS r, doc_id % 4 AS d, doc_id % 10 AS f, doc_id % 9 AS s FROM documents),
direct AS (SELECT 's' || r AS source_id, doc_id FROM n WHERE r = 0 AND d = 1 OR r = 2 AND (d = 2 AND f = 2 OR d = 0) OR r = 4 UNION SELECT 's' || s, doc_id FROM n WHERE s IN (0, 2, 4)),
e AS (SELECT doc_id AS child, doc_id // 3 AS parent FROM n WHERE doc_id % 2 = 1),
reached AS (SELECT source_id, doc_id FROM direct UNION SELECT source_id, child FROM reached JOIN e ON parent = doc_id)
SELECT r.source_id, 'vault/N' || r.doc_id AS id, CASE WHEN d.doc_id IS NULL THEN 'transitive' ELSE 'direct' END AS impact FROM reached r LEFT JOIN direct d ON r.source_id = d.source_id AND r.doc_id = d.doc_id""")
def source_drift(spark, sf_dir):
    state, changes = maintain.refresh(_files(table(spark, sf_dir, "documents")), new_path(spark, "vault-state"))
    notes = maintain.vault.note_source_refs(state.table("notes")).where("not inline").select("id", "ref").distinct()
    edges = written(state.graph().edges, "edges")
    found = written(maintain.source_drift(notes, edges, spark.sql(_SOURCES), spark.sql(_CHANGED)), "source-drift")
    delete_path(spark, state.path)
    return found


@query("""WITH RECURSIVE c AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 11 = 3 THEN 'removed' WHEN doc_id % 13 = 4 THEN 'added' WHEN doc_id % 7 = 5 THEN 'changed' ELSE 'same' END AS change FROM documents),
e AS (SELECT doc_id AS child, doc_id // 3 AS parent FROM c WHERE doc_id % 2 = 1 AND change <> 'removed' AND doc_id // 3 IN (SELECT doc_id FROM c WHERE change <> 'removed')),
a AS (SELECT doc_id FROM c WHERE change IN ('added', 'changed') UNION SELECT child FROM a JOIN e ON parent = doc_id)
SELECT 'vault/N' || doc_id || '.md' AS path, change, CASE WHEN change <> 'removed' THEN sha256(text || CASE WHEN change = 'changed' THEN ' more' ELSE '' END) END AS body, change <> 'removed' AND doc_id IN (SELECT doc_id FROM a) AS affected FROM c""")
def incremental_vault(spark, sf_dir):
    """A state of most documents, then one in which some texts have grown, some notes are gone and some are new."""
    docs = table(spark, sf_dir, "documents")
    gone, new = F.expr("doc_id % 11 = 3"), F.expr("doc_id % 13 = 4 and doc_id % 11 <> 3")
    later = docs.where(~gone).withColumn("text", F.when(F.expr("doc_id % 7 = 5 and doc_id % 13 <> 4"), F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))).otherwise(F.col("text")))
    first, _ = maintain.refresh(_files(docs.where(~new)), new_path(spark, "vault-state"))
    second, changes = maintain.refresh(_files(later), new_path(spark, "vault-state"), first)
    body = second.table("notes").select("path", "id", F.sha2("body", 256).alias("body"))
    reached = maintain.affected(second, changes).withColumn("affected", F.lit(True))
    found = changes.join(body, "path", "left").join(reached, "id", "left").select("path", "change", "body", F.coalesce("affected", F.lit(False)).alias("affected"))
    found = written(found, "incremental-vault")
    for state in (first, second):
        delete_path(spark, state.path)
    return found


@query("SELECT 'vault/N' || doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id // 3 FROM documents WHERE doc_id % 2 = 1)")
def vault_orphans(spark, sf_dir):
    """Notes that derive from none and that none derives from."""
    state, _ = maintain.refresh(_files(table(spark, sf_dir, "documents")), new_path(spark, "vault-state"))
    found = written(state.graph().orphans, "orphans")
    delete_path(spark, state.path)
    return found
