"""Keeping a vault's derived tables: only changed notes are parsed again, and drifted sources name the notes they reach.

A state holds the parsed notes with the digest of their text, their sections and their links.  A refresh compares
digests, parses what is new or changed and takes the other rows over as they are; the new state is a folder of its own, so
readers of the old one are not disturbed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import graph, knowledge_graph
from vellumspark.sources import vault
from vellumspark.tables import written

_TABLES = ("notes", "sections", "links", "places")


@dataclass
class VaultState:
    """The written tables of a vault under one folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def graph(self) -> knowledge_graph.NoteGraph:
        """The graph of notes, from the kept links and anchors: links are resolved anew, no note is parsed."""
        return knowledge_graph.build_graph(self.table("notes"), self.table("links").drop("note_id"), self.table("places"))


def note_changes(files: DataFrame, state: VaultState | None) -> DataFrame:
    """(path, digest, change) of (path, text) files against a state: added, changed, removed or same."""
    now = files.select("path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    if state is None:
        return now.withColumn("change", F.lit("added"))
    before = state.table("notes").select("path", F.col("digest").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") == F.col("before"), "same").otherwise("changed")
    return now.join(before, "path", "full_outer").select("path", "digest", change.alias("change"))


def refresh(files: DataFrame, path: str, previous: VaultState | None = None, root: str = "") -> tuple[VaultState, DataFrame]:
    """A new state of ``files`` under ``path``, and the written changes (path, digest, change) from the previous one."""
    spark = files.sparkSession
    changes = written(note_changes(files, previous), "changes")
    wanted = changes.where("change in ('added', 'changed')").select("path", "digest")
    parsed = written(vault.notes(files.join(wanted, "path"), root).join(wanted, "path"), "parsed")
    by_note = {"sections": vault.sections(parsed), "links": vault.links(parsed).withColumn("note_id", F.col("source")), "places": knowledge_graph.anchors(parsed)}
    fresh = {"notes": parsed, **by_note}
    for name in _TABLES:
        rows = fresh[name]
        if previous is not None:
            kept = previous.table("notes").join(changes.where("change = 'same'").select("path"), "path", "left_semi")
            old = kept if name == "notes" else previous.table(name).join(kept.select(F.col("id").alias("note_id" if name == "links" else "id")), "note_id" if name == "links" else "id", "left_semi")
            rows = rows.unionByName(old)
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return VaultState(spark, path), changes


def derived(edges: DataFrame) -> DataFrame:
    """(source, target) from what others derive from to what derives from it."""
    return edges.where("kind = 'derived_from'").select(F.col("target").alias("source"), F.col("source").alias("target"))


def affected(state: VaultState, changes: DataFrame) -> DataFrame:
    """(id): notes that changed and those that derive from them, over any number of steps."""
    ids = state.table("notes").join(changes.where("change in ('added', 'changed')").select("path"), "path", "left_semi").select(F.lit(0).alias("label"), "id")
    return graph.reach(derived(state.graph().edges), ids).select("id")


def direct_impact(refs: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(source_id, id): notes whose references (id, ref) a drifted source reaches.

    ``sources`` (source_id, path, ingested, current) drift where the current revision is known and another.
    A ``source:`` reference names the source; a repository reference counts if its file, or a folder above it, is among
    the ``changed`` (source_id, file), or if the source has no list of changed files.  Files meet their own folders by equality."""
    drifted = sources.where("current is not null and not current <=> ingested").select("source_id", F.element_at(F.split("path", "/"), -1).alias("repo"))
    files = changed.join(drifted.select("source_id"), "source_id", "left_semi")
    named = refs.where("ref like 'source:%'").select("id", F.substring("ref", F.lit(8), F.length("ref")).alias("source_id"))
    direct = named.join(drifted.select("source_id"), "source_id")
    repo = F.regexp_extract("ref", "^repo://([^@]*)@", 1)
    after = F.split("ref", "/", 4)
    file = F.split_part(F.split_part(F.element_at(after, -1), F.lit("#"), F.lit(1)), F.lit("::"), F.lit(1))
    asked = refs.where("ref like 'repo://%@%'").select("id", repo.alias("repo"), file.alias("file")).join(drifted, "repo")
    whole = asked.join(files.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "id")
    names = F.split("file", "/")
    # The file itself as it is listed, and each folder above it with or without its last slash.
    folders = F.transform(F.slice(F.sequence(F.lit(0), F.size(names) - 1), F.lit(2), F.size(names) - 1), lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/")))
    places = F.array_distinct(F.concat(F.array("file"), folders))
    listed = files.select("source_id", "file").unionByName(files.select("source_id", F.concat(F.regexp_replace("file", "/+$", ""), F.lit("/")).alias("file"))).distinct().withColumnRenamed("file", "place")
    within = asked.select("source_id", "id", F.explode(places).alias("place")).join(listed, ["source_id", "place"], "left_semi").select("source_id", "id")
    return direct.select("source_id", "id").unionByName(whole).unionByName(within).distinct()


def source_drift(refs: DataFrame, edges: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(source_id, id, impact): per drifted source the notes it reaches, ``direct`` by reference and ``transitive`` by derivation."""
    direct = written(direct_impact(refs, sources, changed), "direct-impact")
    reached = graph.reach(derived(edges), direct.select(F.col("source_id").alias("label"), "id")).withColumnRenamed("label", "source_id")
    marked = reached.join(direct.withColumn("impact", F.lit("direct")), ["source_id", "id"], "left")
    return marked.select("source_id", "id", F.coalesce("impact", F.lit("transitive")).alias("impact"))
