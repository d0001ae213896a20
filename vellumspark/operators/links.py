"""Link resolution and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.markdown import casefold_udf


def split_link(value: Column) -> Column:
    """STRUCT(note, anchor, label) of a link: the first ``|`` ends the target, the
    first ``#`` the note."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", ""), "(?s)^\\[\\[(.*)\\]\\]$", "$1")
    target = F.trim(F.substring_index(bare, "|", 1))
    note = F.trim(F.substring_index(target, "#", 1))
    anchor = F.when(F.contains(target, F.lit("#")), F.trim(F.regexp_extract(target, "#(.*)$", 1)))
    label = F.when(F.contains(bare, F.lit("|")), F.trim(F.regexp_extract(bare, "\\|(.*)$", 1)))
    return F.struct(note.alias("note"), anchor.alias("anchor"), label.alias("label"))


def alias_index(names: DataFrame) -> DataFrame:
    """From (id, name) pairs, (name, ids): sorted ids that go by a name, case kept."""
    return names.where("name is not null and name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve_links(links: DataFrame, index: DataFrame, folder: Column | None = None) -> DataFrame:
    """``links`` (source, note) with ``target``.

    Tried in turn: the name as written, without ``.md``, and, if it has no
    folder of its own, its last part.  Of several ids the only one in the
    source's folder wins; otherwise several resolve to null.  An empty name is
    the source itself.
    """
    plain = F.regexp_replace("note", "\\.md$", "")
    stem = F.when(~F.contains("note", F.lit("/")), F.element_at(F.split(plain, "/"), -1))
    tried = links.withColumns({"_n1": F.col("note"), "_n2": plain, "_n3": stem})
    for k in (1, 2, 3):
        tried = tried.join(index.select(F.col("name").alias(f"_n{k}"), F.col("ids").alias(f"_i{k}")), f"_n{k}", "left")
    found = tried.withColumn("_ids", F.coalesce("_i1", "_i2", "_i3"))
    home = folder if folder is not None else F.regexp_extract("source", "^(.*)/[^/]*$", 1)
    near = F.filter("_ids", lambda i: F.regexp_extract(i, "^(.*)/[^/]*$", 1) == home)
    target = F.when(F.col("note") == "", F.col("source")).when(F.size("_ids") == 1, F.element_at("_ids", 1)).when(F.size(near) == 1, F.element_at(near, 1))
    return found.select(*links.columns, target.alias("target"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target, kind, anchor and line."""
    return edges.dropDuplicates(["source", "target", "kind", "anchor", "line"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no resolved edge."""
    ends = edges.where("target is not null").select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.select("id").join(ends, "id", "left_anti")


def reverse_index(pairs: DataFrame) -> DataFrame:
    """From (id, ref), (ref, ids)."""
    return pairs.groupBy("ref").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def check_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """``links`` (target, anchor) with ``state``: an anchor must match exactly one heading or heading path of its target,
    whatever its case, or exactly one ``^block`` mark as it is written."""
    folded = F.when(F.startswith("anchor", F.lit("^")), F.col("anchor")).otherwise(casefold_udf("anchor"))
    keyed = anchors.select(F.col("id").alias("target"), folded.alias("_a")).groupBy("target", "_a").agg(F.count("*").alias("_n"))
    found = links.withColumn("_a", folded).join(keyed, ["target", "_a"], "left")
    state = F.when(F.col("anchor").isNull(), "none").when(F.col("_n").isNull(), "missing_anchor").when(F.col("_n") > 1, "ambiguous_anchor").otherwise("resolved")
    return found.select(*links.columns, state.alias("state"))


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that start or end in a node of ``nodes`` (id), each once."""
    one = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi")
    two = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return one.select(edges.columns).unionByName(two.select(edges.columns)).distinct()
