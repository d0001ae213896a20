"""The graph of a vault's notes and of its projects, as DataFrames made from :func:`vellumspark.sources.vault.notes`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.markdown import casefold_udf, lines_udf
from vellumspark.operators import graph
from vellumspark.operators.links import alias_index, check_anchors, distinct_edges, incident, orphans, resolve_links, reverse_index
from vellumspark.sources import vault


def anchors(notes: DataFrame) -> DataFrame:
    """(id, anchor): what links can point to: each section's heading and heading path, and each ``^block`` mark."""
    own = vault.sections(notes).select("id", "start_line", F.explode(F.array("anchor", "heading")).alias("anchor"))
    named = own.where("anchor <> ''").withColumn("folded", casefold_udf("anchor")).dropDuplicates(["id", "start_line", "folded"])
    marks = notes.select("id", F.explode(lines_udf("body")).alias("l")).select("id", F.regexp_extract("l.line", "(?:^|\\s)(\\^\\S+)\\s*$", 1).alias("anchor"))
    return named.select("id", "anchor").unionByName(marks.where("anchor <> ''"))


@dataclass
class NoteGraph:
    """``edges`` (source, target, kind, anchor, line, context) with the written name where no note has it; ``wanted``
    those that don't lead to one place, with the reason; ``orphans`` (id); ``sources`` (ref, ids)."""

    edges: DataFrame
    wanted: DataFrame
    orphans: DataFrame
    sources: DataFrame


def build_graph(notes: DataFrame, links: DataFrame | None = None, places: DataFrame | None = None) -> NoteGraph:
    """``links`` and ``places`` are those of :func:`vellumspark.sources.vault.links` and :func:`anchors` where they are kept."""
    index = alias_index(vault.note_names(notes))
    resolved = resolve_links(vault.links(notes) if links is None else links, index)
    checked = check_anchors(resolved.withColumn("anchor", F.nullif("anchor", F.lit(""))), anchors(notes) if places is None else places)
    reason = F.when(F.col("target").isNull(), "missing_or_ambiguous_note").when(F.col("state").isin("missing_anchor", "ambiguous_anchor"), F.col("state"))
    named = distinct_edges(checked.select("source", F.coalesce("target", "note").alias("target"), "kind", "anchor", "line", "context", F.col("target").isNotNull().alias("found"), reason.alias("reason")))
    refs = vault.note_source_refs(notes).where("not inline").select("id", "ref").distinct()
    cited = refs.select(F.col("id").alias("source"), F.col("ref").alias("target"), F.lit("source_refs").alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("anchor", "string"), ("line", "int"), ("context", "string"))))
    edges = named.drop("found", "reason").unionByName(cited)
    return NoteGraph(edges, named.where("reason is not null").drop("found"), orphans(notes, named.where("found").select("source", "target")), reverse_index(refs))


@dataclass
class ProjectGraph:
    """``edges`` (parent, child), ``unresolved`` (source, target, kind), ``roots`` (id), ``several`` (child, parents)
    and ``cycles`` (cycle, id)."""

    edges: DataFrame
    unresolved: DataFrame
    roots: DataFrame
    several: DataFrame
    cycles: DataFrame


def project_graph(notes: DataFrame) -> ProjectGraph:
    """Parents of projects are resolved among the projects; what only another note has is a ``non_project_parent``."""
    projects = notes.where("note_type = 'project'")
    asked = vault.links(projects).where("kind = 'parents'").select("source", "note").distinct()
    among = resolve_links(asked, alias_index(vault.note_names(projects)))
    edges = among.where("target is not null").select(F.col("target").alias("parent"), F.col("source").alias("child")).distinct()
    left = resolve_links(among.where("target is null").select("source", "note"), alias_index(vault.note_names(notes)))
    kind = F.when(F.col("target").isNotNull(), "non_project_parent").otherwise("missing_parent")
    unresolved = left.select("source", F.coalesce("target", "note").alias("target"), kind.alias("kind"))
    down = edges.select(F.col("parent").alias("source"), F.col("child").alias("target"))
    return ProjectGraph(edges, unresolved, graph.roots(projects, edges), graph.multi_parent(edges), graph.cycles(down))


def trace(notes: DataFrame, name: str, provenance: DataFrame | None = None) -> dict[str, DataFrame]:
    """What surrounds the note that ``name`` resolves to: ``matches`` (id), ``relations`` (edges), ``refs`` (ref) and,
    from (path, ...) rows of accepted evidence, ``evidence``."""
    spark = notes.sparkSession
    target = name.strip().removeprefix("[[").removesuffix("]]").partition("|")[0].partition("#")[0].strip()
    asked = spark.createDataFrame([("", target)], "source string, note string")
    matches = resolve_links(asked, alias_index(vault.note_names(notes))).where("target <> ''").select(F.col("target").alias("id"))
    refs = vault.note_source_refs(notes).where("not inline").join(matches, "id", "left_semi").select("ref").distinct()
    out = {"matches": matches, "relations": incident(build_graph(notes).edges, matches), "refs": refs}
    if provenance is not None:
        out["evidence"] = provenance.join(notes.join(matches, "id", "left_semi").select("path"), "path", "left_semi")
    return out


# Headings of an evidence map, and the note types that are embedded.
EVIDENCE_MAP = ("evidence map", "证据地图", "证据映射")
EMBEDDED = ("learning", "project", "project-doc", "paper")


def semantic_chunks(notes: DataFrame) -> DataFrame:
    """(chunk_id, note_id, ..., text, content_hash): sections to embed, without evidence maps.  The id digests note,
    heading path and occurrence, so it stays while they do."""
    kept = notes.where(F.col("note_type").isin(*EMBEDDED))
    parts = vault.sections(kept).where(~F.exists("heading_path", lambda h: F.lower(h).isin(*EVIDENCE_MAP)))
    joined = parts.join(kept.select("id", "path", "note_type", "learning_kind", F.col("properties")["aliases"].alias("aliases"), F.coalesce(F.array_contains("list_properties", "aliases"), F.lit(False)).alias("several")), "id")
    quoted = lambda column: F.to_json(F.array(column))
    inside = lambda json_: F.substring(json_, F.lit(2), F.length(json_) - 2)
    path = F.concat(F.lit("["), F.array_join(F.transform("heading_path", lambda h: inside(quoted(h))), ", "), F.lit("]"))
    identity = F.concat(F.lit("["), inside(quoted(F.col("id"))), F.lit(", "), path, F.lit(", "), F.col("occurrence").cast("string"), F.lit("]"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    # The template writes a list of aliases as ['a', "b's"], a single alias as it is, none as [].
    escaped = lambda a: F.replace(F.replace(F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single = lambda a: F.contains(a, F.lit("'")) & ~F.contains(a, F.lit('"'))
    written_out = lambda a: F.when(single(a), F.concat(F.lit('"'), escaped(a), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped(a), F.lit("'"), F.lit("\\'")), F.lit("'")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), written_out), ", "), F.lit("]"))
    names = F.when(F.col("several") | F.col("aliases").isNull(), listed).otherwise(F.try_element_at("aliases", F.lit(1)))
    text = F.concat(F.lit("Title: "), stem, F.lit("\nAliases: "), names, F.lit("\nType: "), "note_type", F.lit("\nHeading: "), F.array_join("heading_path", " / "), F.lit("\n"), "body")
    return joined.withColumn("text", text).select(
        F.concat("id", F.lit("::"), F.substring(F.sha2(identity, 256), 1, 24)).alias("chunk_id"), F.col("id").alias("note_id"), "path", "note_type", "learning_kind", "heading", "heading_path", "anchor", "occurrence", "start_line", "end_line", "text", F.sha2("text", 256).alias("content_hash")
    )
