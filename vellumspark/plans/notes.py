"""Note, graph and lint queries over a vault made of all documents: one note each, around its whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions.markdown import lines_udf
from vellumspark.operators import knowledge_graph, lint, rules
from vellumspark.plans.registry import query, table
from vellumspark.sources import vault
from vellumspark.tables import written

#: The lines of a note before and after the document's text, as SQL that both engines read.
_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'project-doc' WHEN 2 THEN 'learning' ELSE 'paper' END"
_LEARNING = "CASE doc_id % 6 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'odd' ELSE 'project' END"
_PARENT = "CASE doc_id % 40 WHEN 20 THEN doc_id - 20 WHEN 0 THEN doc_id + 20 ELSE doc_id + 4 END"
_SECOND = "CASE WHEN doc_id % 12 = 0 THEN doc_id + 1 WHEN doc_id % 12 = 8 THEN {0} WHEN doc_id % 28 = 4 THEN doc_id ELSE -1 END".format(_PARENT)
_PARENTS = f"CASE WHEN doc_id % 4 = 0 THEN concat('[\"[[N', {_PARENT}, ']]\"', CASE WHEN {_SECOND} < 0 THEN '' ELSE concat(', \"[[N', {_SECOND}, '|x]]\"') END, ']') WHEN doc_id % 8 = 3 THEN '[\"[[N0]]\"]' ELSE '[]' END"
_COMMIT = "CASE WHEN doc_id % 3 = 0 THEN 'abc1' ELSE 'fff0' END"
_MAP = "CASE WHEN doc_id % 3 < 2 THEN '## Evidence Map' ELSE '## Other ##' END"
_BEFORE = ["'---'", f"concat('type: ', {_TYPE}, ' # kind')", f"concat('learning_kind: ', {_LEARNING})", f"concat('parents: ', {_PARENTS})",
           f"concat('source_refs: [repo://r', doc_id % 5, '@', {_COMMIT}, '/x, ''source:s', doc_id % 7, ''']')", "CASE WHEN doc_id % 50 = 7 THEN 'x: y' ELSE '---' END", "'# Overview'"]
_AFTER = ["concat('See [[N', (doc_id * 7) % 1500, '#OVERVIEW]] and `[[no]]` ![[N', doc_id + 1, '#^b1]].')", "'```'", "'# hidden [[no]]'", "'```'", _MAP, "concat('at', repeat(' repo://a/1', CAST(doc_id % 6 AS INT)), CASE WHEN doc_id % 9 = 0 THEN ' /Users/x' ELSE '' END)",
          "'<!-- [[no]]'", "'--> [[no]]'", "concat('## ', CASE doc_id % 5 WHEN 0 THEN '2. Evaluation' WHEN 1 THEN 'Task' ELSE 'Detail' END)", "CASE WHEN doc_id % 2 = 0 THEN 'tail ^b1' ELSE 'tail' END"]
_BROKEN = "doc_id % 50 = 7"
#: Line feeds of the text, and what a section of it digests (blanks at its ends go).
_FEEDS = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))"

_SQL = f"""n AS (SELECT doc_id, source, coalesce(text, '') AS text, {_FEEDS} AS feeds, 'vault/' || source || '/N' || doc_id AS id, {_BROKEN} AS broken, CASE WHEN {_BROKEN} THEN NULL ELSE {_TYPE} END AS type, {_LEARNING} AS learning, {_PARENT} AS parent, {_SECOND} AS second,
'repo://r' || (doc_id % 5) || '@' || {_COMMIT} || '/x' AS repo, 'source:s' || (doc_id % 7) AS src, doc_id % 3 < 2 AS mapped FROM documents)"""


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = [*map(F.expr, _BEFORE), F.coalesce("text", F.lit("")), *map(F.expr, _AFTER)]
    return docs.select("doc_id", F.concat(F.lit("vault/"), "source", F.lit("/N"), "doc_id", F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


def _notes(spark, sf_dir):
    return vault.notes(_files(spark, sf_dir).drop("doc_id"))


def _parsed(spark, sf_dir):
    """The notes as a table, for queries that read them more than once."""
    return written(_notes(spark, sf_dir), "notes")


@query(f"""WITH {_SQL} SELECT id, type AS note_type, CASE WHEN broken THEN NULL ELSE learning END AS learning_kind, CASE WHEN broken THEN NULL ELSE repo || '|' || src END AS refs,
CASE WHEN broken OR doc_id % 4 IN (1, 2) OR doc_id % 8 = 7 THEN NULL WHEN doc_id % 4 = 3 THEN '[[N0]]' ELSE '[[N' || parent || ']]' || CASE WHEN second < 0 THEN '' ELSE '|[[N' || second || '|x]]' END END AS parents,
CASE WHEN broken THEN 0 ELSE 6 END::BIGINT AS line_offset, broken, CASE WHEN broken THEN NULL ELSE sha256('# Overview' || chr(10) || text) END AS begin_sha256 FROM n""")
def frontmatter_parse(spark, sf_dir):
    p = F.col("properties")
    # What follows the text is cut off, so that the digest is about the text that came through.
    begin = F.when(F.col("parse_error").isNull(), F.sha2(F.expr("substring_index(body, concat('\nSee [[N'), 1)"), 256))
    return _notes(spark, sf_dir).select(
        "id", "note_type", "learning_kind", F.array_join(p["source_refs"], "|").alias("refs"), F.nullif(F.array_join(p["parents"], "|"), F.lit("")).alias("parents"), F.col("body_line_offset").cast("long").alias("line_offset"), F.col("parse_error").isNotNull().alias("broken"), begin.alias("begin_sha256")
    )


_SECTIONS = """s AS (SELECT id, doc_id, type, broken, 1 AS k, 'Overview' AS path, 7 AS first, 12 + feeds AS last, sha256(regexp_replace('# Overview' || chr(10) || text || chr(10) || 'See [[N' || ((doc_id * 7) % 1500) || '#OVERVIEW]] and `[[no]]` ![[N' || (doc_id + 1) || '#^b1]].' || chr(10) || '```' || chr(10) || '# hidden [[no]]' || chr(10) || '```', '\\s+$', '')) AS digest FROM n
UNION ALL SELECT id, doc_id, type, broken, 2, 'Overview#' || CASE WHEN mapped THEN 'Evidence Map' ELSE 'Other' END, 13 + feeds, 16 + feeds, NULL FROM n
UNION ALL SELECT id, doc_id, type, broken, 3, 'Overview#' || CASE doc_id % 5 WHEN 0 THEN '2. Evaluation' WHEN 1 THEN 'Task' ELSE 'Detail' END, 17 + feeds, 18 + feeds, NULL FROM n)"""


@query(f"WITH {_SQL}, {_SECTIONS} SELECT id, path, 1::BIGINT AS occurrence, first::BIGINT AS start_line, last::BIGINT AS end_line, digest FROM s UNION ALL SELECT id, '', 1, 1, 6, NULL FROM n WHERE broken")
def sectionize(spark, sf_dir):
    found = vault.sections(_notes(spark, sf_dir))
    digest = F.when(F.col("anchor") == "Overview", F.col("content_hash"))
    return found.select("id", F.col("anchor").alias("path"), F.col("occurrence").cast("long").alias("occurrence"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), digest.alias("digest"))


@query(f"WITH {_SQL} SELECT id, unnest(['N' || ((doc_id * 7) % 1500), 'N' || (doc_id + 1)]) AS note, unnest(['OVERVIEW', '^b1']) AS anchor, (9 + feeds)::BIGINT AS line, unnest([false, true]) AS embedded FROM n UNION ALL SELECT id, 'N0', NULL, 4, false FROM n WHERE broken AND doc_id % 8 = 3")
def body_links(spark, sf_dir):
    found = vault.links(_notes(spark, sf_dir)).where("line is not null")
    return found.select(F.col("source").alias("id"), "note", "anchor", F.col("line").cast("long").alias("line"), (F.col("kind") == "embed").alias("embedded"))


@query(f"WITH {_SQL} SELECT id, (CASE WHEN broken THEN 6 ELSE 0 END + feeds + 8)::BIGINT AS visible, length(text)::BIGINT AS chars FROM n")
def visible_lines(spark, sf_dir):
    notes = _notes(spark, sf_dir).select("id", "parse_error", lines_udf("body").alias("l"))
    # The characters of the text's own lines: all visible ones but those around it, and its line feeds.
    own = F.slice("l", F.when(F.col("parse_error").isNull(), 2).otherwise(8), F.size("l") - F.when(F.col("parse_error").isNull(), 7).otherwise(13))
    chars = F.aggregate(own, F.lit(0), lambda n, x: n + F.length(x["line"])) + F.size(own) - 1
    return notes.select("id", F.size("l").cast("long").alias("visible"), chars.cast("long").alias("chars"))


_ROLES = "concat_ws(',', CASE WHEN doc_id % 5 <> 1 THEN 'task' END, CASE WHEN doc_id % 5 <> 0 THEN 'evaluation' END, 'challenges,solutions,conclusions', CASE WHEN NOT mapped THEN 'evidence' END)"


@query(f"WITH {_SQL} SELECT id, {_ROLES} AS missing FROM n WHERE type = 'project'")
def project_roles(spark, sf_dir):
    from vellumspark.functions.markdown import missing_roles_udf

    return _notes(spark, sf_dir).where("note_type = 'project'").select("id", F.array_join(missing_roles_udf("body"), ",").alias("missing"))


#: Links with what they resolve to: t has the note of a number.
_LINKS = """l AS (SELECT n.id AS source, 'N' || x.k AS note, x.kind, x.anchor, CASE WHEN x.kind = 'parents' THEN NULL WHEN x.kind = 'wikilink' AND x.anchor IS NULL THEN 4 ELSE 9 + n.feeds END AS line, t.id AS target, t.doc_id AS target_doc FROM n,
LATERAL (SELECT (n.doc_id * 7) % 1500 AS k, 'wikilink' AS kind, 'OVERVIEW' AS anchor UNION ALL SELECT n.doc_id + 1, 'embed', '^b1' UNION ALL SELECT n.parent, 'parents', NULL WHERE n.type = 'project' UNION ALL SELECT n.second, 'parents', NULL WHERE n.type = 'project' AND n.second >= 0 UNION ALL SELECT 0, 'wikilink', NULL WHERE n.broken AND n.doc_id % 8 = 3 UNION ALL SELECT 0, 'parents', NULL WHERE n.type = 'paper' AND n.doc_id % 8 = 3) x
LEFT JOIN n t ON t.doc_id = x.k),
g AS (SELECT DISTINCT source, coalesce(target, note) AS target, kind, anchor, line, target IS NOT NULL AS found, CASE WHEN target IS NULL THEN 'missing_or_ambiguous_note' WHEN anchor = '^b1' AND target_doc % 2 <> 0 THEN 'missing_anchor' END AS reason FROM l)"""


@query(f"WITH {_SQL}, {_LINKS} SELECT source, target, kind, anchor, line::BIGINT AS line FROM g UNION ALL SELECT id, unnest([repo, src]), 'source_refs', NULL, NULL FROM n WHERE NOT broken")
def graph_edges(spark, sf_dir):
    return knowledge_graph.build_graph(_parsed(spark, sf_dir)).edges.select("source", "target", "kind", "anchor", F.col("line").cast("long").alias("line"))


@query(f"WITH {_SQL}, {_LINKS} SELECT source, target, kind, anchor, line::BIGINT AS line, reason FROM g WHERE reason IS NOT NULL")
def wanted_links(spark, sf_dir):
    return knowledge_graph.build_graph(_parsed(spark, sf_dir)).wanted.select("source", "target", "kind", "anchor", F.col("line").cast("long").alias("line"), "reason")


@query(f"WITH {_SQL}, {_LINKS} SELECT id FROM n WHERE id NOT IN (SELECT source FROM g WHERE found) AND id NOT IN (SELECT target FROM g WHERE found)")
def graph_orphans(spark, sf_dir):
    return knowledge_graph.build_graph(_parsed(spark, sf_dir)).orphans


_PROJECTS = """p AS (SELECT DISTINCT n.id, n.doc_id, x.k AS to_doc FROM n, LATERAL (SELECT n.parent AS k UNION ALL SELECT n.second WHERE n.second >= 0) x WHERE n.type = 'project'),
e AS (SELECT p.id AS child, p.doc_id AS child_doc, t.id AS parent, t.doc_id AS parent_doc FROM p JOIN n t ON t.doc_id = p.to_doc AND t.type = 'project'),
u AS (SELECT p.id AS source, coalesce(t.id, 'N' || p.to_doc) AS target, CASE WHEN t.id IS NULL THEN 'missing_parent' ELSE 'non_project_parent' END AS kind FROM p LEFT JOIN n t ON t.doc_id = p.to_doc WHERE t.type IS DISTINCT FROM 'project'),
c AS (SELECT a.child AS id, least(a.child, a.parent) AS cycle FROM e a JOIN e b ON a.parent = b.child AND a.child = b.parent WHERE a.child <> a.parent
UNION SELECT child, child FROM e WHERE child = parent AND child NOT IN (SELECT a.child FROM e a JOIN e b ON a.parent = b.child AND a.child = b.parent WHERE a.child <> a.parent))"""


@query(f"WITH {_SQL}, {_PROJECTS} SELECT 'edge' AS what, parent AS a, child AS b FROM e UNION ALL SELECT kind, source, target FROM u UNION ALL SELECT 'root', id, NULL FROM n WHERE type = 'project' AND id NOT IN (SELECT child FROM e) UNION ALL SELECT 'cycle', cycle, id FROM c UNION ALL SELECT 'several', child, string_agg(parent, ',' ORDER BY parent) FROM e GROUP BY child HAVING count(*) > 1")
def project_graph(spark, sf_dir):
    g = knowledge_graph.project_graph(_parsed(spark, sf_dir))
    none = F.lit(None).cast("string")
    rows = [g.edges.select(F.lit("edge"), "parent", "child"), g.unresolved.select("kind", "source", "target"), g.roots.select(F.lit("root"), "id", none), g.cycles.select(F.lit("cycle"), "cycle", "id"), g.several.select(F.lit("several"), "child", F.array_join("parents", ","))]
    first, *rest = (r.toDF("what", "a", "b") for r in rows)
    for r in rest:
        first = first.unionByName(r)
    return first


#: The registry of the lint query: repositories r0 to r3, of which r0 and r1 have a folder, and sources s0 to s4.
_HEADS = "h AS (SELECT 'repos/r' || k AS path, 'abc1234' AS head, k FROM range(4) t(k))"


_LINT = f"""WITH {_SQL}, {_LINKS}, {_PROJECTS}, {_HEADS}, m AS (SELECT *, id || '.md' AS path FROM n WHERE NOT broken)
SELECT 'unresolved_link' AS kind, source AS subject, concat_ws(' ', reason, kind, target || coalesce('#' || anchor, ''), line::VARCHAR) AS detail FROM g WHERE reason IS NOT NULL
UNION ALL SELECT 'invalid_frontmatter', id || '.md', 'unclosed frontmatter' FROM n WHERE broken
UNION ALL SELECT 'invalid_frontmatter', id || '.md', '' FROM n WHERE broken
UNION ALL SELECT 'path_heavy_prose', path, '' FROM m WHERE type IN ('project', 'project-doc') AND doc_id % 6 > 3
UNION ALL SELECT 'PROVENANCE_MIGRATION_WARNING', path, '' FROM m WHERE type IN ('project', 'project-doc')
UNION ALL SELECT 'evidence_map_not_last', path, '' FROM m WHERE type IN ('project', 'project-doc') AND mapped
UNION ALL SELECT 'project_home_incomplete', path, {_ROLES} FROM m WHERE type = 'project'
UNION ALL SELECT 'invalid_learning_kind', path, '' FROM m WHERE type <> 'learning' OR learning = 'odd'
UNION ALL SELECT 'absolute_path', id || '.md', '' FROM n WHERE doc_id % 9 = 0
UNION ALL SELECT 'invalid_project_parent', source, kind || ' ' || target FROM u
UNION ALL SELECT 'project_cycle', cycle, string_agg(id, ',' ORDER BY id) FROM c GROUP BY cycle
UNION ALL SELECT 'duplicate_project_parent', path, '' FROM m WHERE type = 'project' AND second = parent
UNION ALL SELECT 'self_project_parent', path, '' FROM m WHERE type = 'project' AND (parent = doc_id OR second = doc_id)
UNION ALL SELECT 'parents_on_non_project', path, '' FROM m WHERE type = 'paper' AND doc_id % 8 = 3
UNION ALL SELECT 'missing_source', path, head FROM h WHERE k > 1
UNION ALL SELECT 'unregistered_source_ref', path, src FROM m WHERE doc_id % 7 > 4
UNION ALL SELECT 'unregistered_repo_ref', path, repo FROM m WHERE doc_id % 5 > 3
UNION ALL SELECT 'stale_repo_ref', path, repo || ' abc1234' FROM m WHERE doc_id % 5 <= 3 AND doc_id % 3 <> 0"""


def _lint(spark, sf_dir):
    heads = spark.range(4).select(F.concat(F.lit("repos/r"), "id").alias("path"), F.lit("abc1234").alias("head"))
    sources = spark.range(5).select(F.concat(F.lit("s"), "id").alias("source_id"))
    return lint.lint(_files(spark, sf_dir), _parsed(spark, sf_dir), heads, sources, heads.where("path < 'repos/r2'"))


@query(_LINT)
def lint_rules(spark, sf_dir):
    return _lint(spark, sf_dir)


@query(f"SELECT kind, count(*)::BIGINT AS n FROM ({_LINT}) GROUP BY kind")
def issue_counts(spark, sf_dir):
    return rules.issue_counts(_lint(spark, sf_dir))


@query(f"""WITH {_SQL}, {_SECTIONS} SELECT id AS note_id, path AS anchor, type AS note_type, id || '::' || substr(sha256('["' || id || '", ["' || replace(path, '#', '", "') || '"], 1]'), 1, 24) AS chunk_id FROM s WHERE NOT broken AND path <> 'Overview#Evidence Map'""")
def semantic_chunk_ids(spark, sf_dir):
    return knowledge_graph.semantic_chunks(_parsed(spark, sf_dir)).select("note_id", "anchor", "note_type", "chunk_id")
