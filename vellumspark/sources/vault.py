"""Reading a folder of notes and its registries into DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.functions.markdown import links_udf, note_udf, sections_udf
from vellumspark.functions.text import source_ref, source_refs


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every ``.md`` file under a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def notes(files: DataFrame, root: str = "") -> DataFrame:
    """Notes with id, type, properties, body, line offset and parse error."""
    note = F.col("n")
    parsed = files.withColumn("n", note_udf("text"))
    first = lambda key: F.try_element_at(note["properties"][key], F.lit(1))
    name = F.regexp_replace("path", "^(file:)?/*" + root.strip("/").replace(".", "\\.") + "/*" if root else "^$", "")
    return parsed.select(
        F.regexp_replace(name, "\\.[^./]*$", "").alias("id"), "path", first("type").alias("note_type"), first("learning_kind").alias("learning_kind"), F.coalesce(first("origin"), F.lit("human")).alias("origin"),
        note["properties"].alias("properties"), note["lists"].alias("list_properties"), note["body"].alias("body"), note["offset"].alias("body_line_offset"), note["error"].alias("parse_error"),
    )


def sections(notes_: DataFrame) -> DataFrame:
    return notes_.select("id", F.explode(sections_udf("body", "body_line_offset")).alias("s")).select("id", "s.*")


#: Properties whose values are links to other notes.
LINK_PROPERTIES = ("projects", "derived_from", "parents")


def links(notes_: DataFrame) -> DataFrame:
    """Body links and property links; the latter have no line."""
    body = notes_.select(F.col("id").alias("source"), F.explode(links_udf("body", "body_line_offset")).alias("l"))
    body = body.select("source", F.when(F.col("l.embedded"), "embed").otherwise("wikilink").alias("kind"), "l.note", "l.anchor", "l.label", "l.line", "l.context")
    pairs = notes_.select(F.col("id").alias("source"), F.explode("properties").alias("kind", "values")).where(F.col("kind").isin(*LINK_PROPERTIES))
    from vellumspark.operators.links import split_link

    prop = pairs.select("source", "kind", F.explode("values").alias("v")).select("source", "kind", split_link(F.col("v")).alias("x"))
    prop = prop.select("source", "kind", "x.note", "x.anchor", "x.label", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("context"))
    return body.unionByName(prop)


def note_names(notes_: DataFrame) -> DataFrame:
    """(id, name): id, path, file name, stem and aliases of each note."""
    file = F.element_at(F.split("path", "/"), -1)
    names = F.array(F.col("id"), F.col("path"), file, F.regexp_replace(file, "\\.[^.]*$", ""))
    names = F.concat(names, F.coalesce(F.col("properties")["aliases"], F.array().cast("array<string>")))
    return notes_.select("id", F.explode(F.array_distinct(names)).alias("name"))


def note_source_refs(notes_: DataFrame) -> DataFrame:
    """(id, ref, inline): references in the properties and in the body."""
    own = notes_.select("id", F.explode(F.col("properties")["source_refs"]).alias("r")).select("id", source_ref(F.col("r")).alias("ref"), F.lit(False).alias("inline"))
    return own.unionByName(notes_.select("id", F.explode(source_refs("body")).alias("ref"), F.lit(True).alias("inline")))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Source records of a registry file: ``- id:``, ``- source_id:`` or ``- rank:``
    starts one, a line without indentation names its kind.

    The lines of one file are folded in its own group, ordered by number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("number", "line"))
    w = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike("^\\s*-\\s+(id|source_id|rank):")
    header = F.nullif(F.regexp_extract("line", "^([A-Za-z_][A-Za-z0-9_-]*):\\s*$", 1), F.lit(""))
    marked = files.select("file", "line", F.sum(starts.cast("int")).over(w).alias("record"), F.last(header, ignorenulls=True).over(w).alias("kind"))
    key, value = F.regexp_extract("line", "^\\s*(?:-\\s+)?([A-Za-z_][A-Za-z0-9_-]*):", 1), F.regexp_extract("line", "^\\s*(?:-\\s+)?[A-Za-z_][A-Za-z0-9_-]*:\\s*[\"']?(.*?)[\"']?\\s*$", 1)
    fields = marked.where("record > 0").select("file", "record", "kind", key.alias("key"), value.alias("value")).where("key <> '' and value <> ''")
    wide = fields.groupBy("file", "record").agg(F.min("kind").alias("kind"), *(F.min(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in REGISTRY_KEYS))
    source = F.regexp_replace(F.coalesce("id", "source_id"), "^source:", "")
    return wide.select(source.alias("source_id"), "kind", F.coalesce("local_path", "path", "code_local_path").alias("path"), F.coalesce("revision", "head", "code_head").alias("revision"), "remote", "branch").where("source_id is not null or path is not null")


REGISTRY_KEYS = ("id", "source_id", "rank", "local_path", "path", "code_local_path", "revision", "head", "code_head", "remote", "branch")


def resolve_sources(wanted: DataFrame, registry_: DataFrame, manifest: DataFrame) -> DataFrame:
    """``wanted`` source ids with path and revision: the registry's, else the manifest's."""
    asked = wanted.select(F.regexp_replace("source_id", "^source:", "").alias("source_id")).distinct()
    one = registry_.select("source_id", F.col("path").alias("p1"), F.col("revision").alias("r1"), F.lit(True).alias("in_registry"))
    two = manifest.select("source_id", F.col("path").alias("p2"), F.col("revision").alias("r2"))
    both = asked.join(one, "source_id", "left").join(two, "source_id", "left")
    return both.select("source_id", F.coalesce("p1", "p2").alias("path"), F.coalesce("r1", "r2").alias("revision"), F.coalesce("in_registry", F.lit(False)).alias("in_registry"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records with their line numbers, and the lines that are no JSON object."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    numbered = lines.select((F.col("p") + 1).alias("line_no"), F.trim("line").alias("line")).where("line <> ''")
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = numbered.withColumn("r", F.from_json("line", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = ~F.col("line").startswith("{") | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("line_no", *(F.col(f"r.{n}") for n in schema.fieldNames())), parsed.where(bad).select("line_no", F.when(F.col("line").startswith("{"), "invalid JSON").otherwise("not an object").alias("error"))


def evaluation_suite(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, query, expected_ids, required_terms, top_k)."""
    schema = "top_k int, cases array<struct<id string, query string, expected_ids array<string>, required_terms array<string>>>"
    suite = spark.read.schema(schema).json(path, multiLine=True)
    return suite.select(F.coalesce("top_k", F.lit(5)).alias("top_k"), F.posexplode("cases").alias("p", "c")).select(F.coalesce("c.id", F.col("p").cast("string")).alias("case_id"), "c.query", "c.expected_ids", F.coalesce("c.required_terms", F.array().cast("array<string>")).alias("required_terms"), "top_k")


def ledger(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Header keys of a claim ledger, and its records as (line_no, record)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    head = lines.where(F.col("line").rlike("^[A-Za-z_]+: ")).collect()  # the header, not the records
    return {r["line"].split(": ", 1)[0]: r["line"].split(": ", 1)[1].strip() for r in head}, lines.where(F.col("line").startswith("- {")).select((F.col("p") + 1).alias("line_no"), F.substring("line", 3, 1 << 30).alias("record"))


def config_value(text: str, key: str, default: str | None = None) -> str | None:
    """The value of the first line that starts with the key; quotes go."""
    for line in text.splitlines():
        if line.startswith(f"{key}:"):
            return line.split(":", 1)[1].strip().strip("\"'")
    return default


def flag(value: str | None) -> bool:
    return (value or "").strip().lower() in {"1", "true", "yes", "on"}
