"""Evidence of facts: line ranges of source files, checked and bound by their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.intervals import interval_join
from vellumspark.sources.lines import file_digests, line_counts


def plain_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes; what climbs above its beginning keeps its ``..``."""
    none = F.array().cast("array<string>")

    def step(done: Column, name: Column) -> Column:
        up = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when((name == "") | (name == "."), done).when((name == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, name))

    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def asked_evidence(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a fact and evidence id, with its file, its lines and the first reason against it that needs no file.

    ``facts`` (fact_id, solution_id, source_id, evidence_type, evidence_ids, anchor of kind, path, start_line, end_line,
    revision); ``sources`` (source_id, kind, root, revision)."""
    known = sources.select("source_id", F.col("kind").alias("source_kind"), "root", F.nullif("revision", F.lit("")).alias("source_revision"))
    each = facts.withColumn("evidence_id", F.explode("evidence_ids")).join(known, "source_id", "left")
    file, root = plain_path(F.coalesce("anchor.path", F.lit(""))), plain_path(F.col("root"))
    inside = (file == root) | ((root != "") & F.startswith(file, F.concat(root, F.lit("/")))) | ((root == "") & ~F.startswith(file, F.lit("/")) & ~F.startswith(file, F.lit("..")))
    reason = (
        F.when(F.coalesce(F.col("anchor.kind") != "file_lines", F.lit(True)), "evidence anchor must be file_lines")
        .when(F.col("root").isNull(), "EVIDENCE_SOURCE_MISMATCH: unknown source")
        .when((F.col("evidence_type") == "code_demonstrated") & (F.coalesce("source_kind", F.lit("")) != "repository"), "CODE_DEMONSTRATED_WRONG_SOURCE_KIND")
        .when(~inside, "EVIDENCE_SOURCE_MISMATCH: path")
    )
    asked = F.nullif("anchor.revision", F.lit(""))
    other = F.coalesce(~F.startswith("source_revision", asked), F.lit(False))
    return each.select("fact_id", "evidence_id", "solution_id", "source_id", file.alias("file"), F.col("anchor.start_line").cast("long").alias("low"), F.col("anchor.end_line").cast("long").alias("high"), F.coalesce(asked, "source_revision").alias("source_revision"), reason.alias("reason"), (other & (reason.isNull() | reason.endswith(": path"))).alias("other_revision"))


def bind_evidence(facts: DataFrame, sources: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, errors): the excerpt and the digests of all sound evidence, and (fact_id, evidence_id, error).

    ``lines`` are (file, number, line), as :func:`vellumspark.sources.lines.numbered_lines` gives them, by paths like the anchors'.  Ranges are
    1-based and inclusive and must lie inside the file.  A gate writes bindings only where there is no error at all."""
    asked = asked_evidence(facts, sources)
    sized = asked.join(line_counts(lines), "file", "left")
    fits = (F.col("low") >= 1) & (F.col("high") >= F.col("low")) & (F.col("high") <= F.col("lines"))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("lines").isNull(), "evidence file missing").when(~F.coalesce(fits, F.lit(False)), "invalid evidence line range")
    checked = sized.withColumn("reason", reason)
    both = F.array(F.when(F.col("other_revision"), "EVIDENCE_SOURCE_MISMATCH: revision"), F.col("reason"))
    errors = checked.select("fact_id", "evidence_id", F.explode(F.filter(both, lambda r: r.isNotNull())).alias("error"))
    sound = checked.where("reason is null")
    ranges = sound.select("file", "low", "high").distinct()
    read = interval_join(lines.select("file", "number", "line"), ranges, ["file"], "number", "low", "high")
    excerpts = read.groupBy("file", "low", "high").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("excerpt"))
    whole = file_digests(lines.join(ranges.select("file").distinct(), "file", "left_semi")).withColumnRenamed("sha256", "source_file_sha256")
    bound = sound.join(excerpts, ["file", "low", "high"]).join(whole, "file")
    bindings = bound.select("evidence_id", "fact_id", "solution_id", "source_id", "file", F.col("low").alias("start_line"), F.col("high").alias("end_line"), "source_revision", "excerpt", F.sha2(F.col("excerpt").cast("binary"), 256).alias("excerpt_sha256"), "source_file_sha256")
    return bindings, errors
