"""Declared reuse: links of projects to learning notes that stand in a section about applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.markdown import casefold_udf
from vellumspark.operators.intervals import interval_join

# Headings of sections that record applications, and what such a record is worth.
APPLICATION_HEADINGS = ("applications", "application records", "应用记录", "复用记录")
VERIFICATION = "declared-use-not-validated-effect"


def application_sections(sections: DataFrame) -> DataFrame:
    """Sections that lie under a heading of an application record, whatever its case."""
    folded = casefold_udf(F.array_join("heading_path", "\n"))
    return sections.where(F.arrays_overlap(F.split(folded, "\n"), F.array(*(F.lit(h) for h in APPLICATION_HEADINGS))))


def reuse_report(edges: DataFrame, notes: DataFrame, sections: DataFrame) -> DataFrame:
    """(project_note, learning, line, context, record, verification) of each declared use.

    ``edges`` are a note graph's, ``sections`` the notes' own.  Only links in the text of projects and their documents to
    learning notes count, and only where the section that holds their line records applications."""
    kinds = notes.select("id", "note_type")
    users = kinds.where("note_type in ('project', 'project-doc')").select(F.col("id").alias("source"))
    lessons = kinds.where("note_type = 'learning'").select(F.col("id").alias("target"))
    used = edges.where("kind in ('wikilink', 'embed') and line is not null").select("source", "target", "line", "context")
    used = used.join(users, "source", "left_semi").join(lessons, "target", "left_semi")
    held = application_sections(sections).select(F.col("id").alias("source"), "start_line", "end_line", F.col("body").alias("record"))
    found = interval_join(used, held, ["source"], "line", "start_line", "end_line")
    return found.select(F.col("source").alias("project_note"), F.col("target").alias("learning"), "line", "context", "record", F.lit(VERIFICATION).alias("verification"))
