"""The vault's lint: each kind of issue as a constraint query, (kind, subject, detail) rows.

Kinds are fixed values.  Notes come from :func:`vellumspark.sources.vault.notes`; a note whose frontmatter is refused has
no properties and counts for ``invalid_frontmatter`` and its links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.markdown import missing_roles_udf
from vellumspark.functions.text import REPO_REF
from vellumspark.operators.knowledge_graph import EVIDENCE_MAP, build_graph, project_graph
from vellumspark.operators.rules import issues, report
from vellumspark.sources import vault

#: A home note or document of a project writes out so many repository paths at most.
PATHS = 3


def style_issues(notes: DataFrame) -> DataFrame:
    sound = notes.where("parse_error is null")
    documents = sound.where(F.col("note_type").isin("project", "project-doc"))
    heavy = documents.where(F.regexp_count("body", F.lit("repo://[^\\s)`]+")) > PATHS)
    raw = documents.join(vault.note_source_refs(documents).where("not inline and ref like 'repo://%'"), "id", "left_semi")
    parts = vault.sections(documents)
    last = parts.where(F.lower("heading").isin(*EVIDENCE_MAP)).groupBy("id").agg(F.max("start_line").alias("last"))
    later = parts.join(last, "id").where((F.col("start_line") > F.col("last")) & ~F.array_contains("heading_path", "Evidence Map"))
    homes = sound.where("note_type = 'project'").withColumn("missing", missing_roles_udf("body"))
    odd = F.coalesce(F.col("note_type") != "learning", F.lit(True)) | ~F.col("learning_kind").isin("project", "mechanism")
    return report(
        issues(notes.where("parse_error is not null"), "invalid_frontmatter", "path", F.col("parse_error")),
        issues(heavy, "path_heavy_prose", "path"),
        issues(raw, "PROVENANCE_MIGRATION_WARNING", "path"),
        issues(documents.join(later, "id", "left_semi"), "evidence_map_not_last", "path"),
        issues(homes.where(F.size("missing") > 0), "project_home_incomplete", "path", F.array_join("missing", ",")),
        issues(sound.where(F.coalesce("learning_kind", F.lit("")) != "").where(odd), "invalid_learning_kind", "path"),
    )


def absolute_paths(files: DataFrame) -> DataFrame:
    """From (path, text)."""
    return issues(files.where(F.contains("text", F.lit("/Users/")) | F.contains("text", F.lit("C:\\Users\\"))), "absolute_path", "path")


def unclosed_blocks(files: DataFrame) -> DataFrame:
    """Files that open a block of properties and close none, besides what the parser says of the note."""
    opened = F.startswith("text", F.lit("---\n")) & ~F.contains(F.substring("text", 6, 1 << 30), F.lit("\n---"))
    return issues(files.where(opened), "invalid_frontmatter", "path")


def parent_issues(notes: DataFrame) -> DataFrame:
    """A parent link is compared by its target without quotes, brackets, label and heading."""
    projects = project_graph(notes)
    asked = vault.links(notes).where("kind = 'parents'").select(F.col("source").alias("id"), "note")
    twice = asked.groupBy("id", "note").count().where("count > 1")
    own = resolve_self(asked, notes.where("note_type = 'project'"))
    others = notes.where("coalesce(note_type, '') <> 'project'").where(F.size(F.coalesce(F.col("properties")["parents"], F.array().cast("array<string>"))) > 0)
    return report(
        issues(projects.unresolved, "invalid_project_parent", "source", F.concat_ws(" ", "kind", "target")),
        issues(projects.cycles.groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")), "project_cycle", "cycle", F.col("ids")),
        issues(notes.join(twice, "id", "left_semi"), "duplicate_project_parent", "path"),
        issues(notes.join(own, "id", "left_semi"), "self_project_parent", "path"),
        issues(others, "parents_on_non_project", "path"),
    )


def resolve_self(asked: DataFrame, projects: DataFrame) -> DataFrame:
    """(id) of projects that a parent link of their own names, by any of their names."""
    return asked.join(vault.note_names(projects).withColumnRenamed("name", "note"), ["id", "note"]).select("id").distinct()


def link_issues(notes: DataFrame) -> DataFrame:
    return issues(build_graph(notes).wanted, "unresolved_link", "source", F.concat_ws(" ", "reason", "kind", F.concat("target", F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))), F.col("line").cast("string")))


def source_issues(notes: DataFrame, heads: DataFrame, sources: DataFrame, folders: DataFrame) -> DataFrame:
    """References against the registry: ``heads`` (path, head) of its repositories, ``sources`` (source_id), and the
    ``folders`` (path) that there are."""
    refs = vault.note_source_refs(notes).where("not inline").select("id", "ref").distinct().join(notes.select("id", "path"), "id")
    named = refs.where("ref like 'source:%'").withColumn("source_id", F.substring("ref", F.lit(8), F.length("ref")))
    repos = refs.where(~F.col("ref").startswith("source:") & F.col("ref").rlike("^" + REPO_REF)).select("path", "ref", F.regexp_extract("ref", REPO_REF, 1).alias("name"), F.regexp_extract("ref", REPO_REF, 2).alias("commit"))
    # Of several paths with one last part the last one stands for all.
    known = heads.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.max_by("head", "path").alias("head"))
    both = repos.join(known, "name", "left")
    return report(
        issues(heads.join(folders.select("path"), "path", "left_anti"), "missing_source", "path", F.col("head")),
        issues(named.join(sources.select("source_id"), "source_id", "left_anti"), "unregistered_source_ref", "path", F.col("ref")),
        issues(both.where("head is null"), "unregistered_repo_ref", "path", F.col("ref")),
        issues(both.where("head is not null and not startswith(head, commit)"), "stale_repo_ref", "path", F.concat_ws(" ", "ref", "head")),
    )


def lint(files: DataFrame, notes: DataFrame, heads: DataFrame, sources: DataFrame, folders: DataFrame) -> DataFrame:
    return report(link_issues(notes), style_issues(notes), absolute_paths(files), unclosed_blocks(files), parent_issues(notes), source_issues(notes, heads, sources, folders))
