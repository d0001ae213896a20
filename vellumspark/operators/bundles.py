"""Accepted evidence bundles: a distributed scan of their files against their manifests, the index of acceptances, and
the audit of what they accepted.

Everything works on rows (bundle, name, sha256, content), one a file; only the two small JSON members of a bundle are ever parsed.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.functions.markdown import region_span
from vellumspark.functions.text import safe_id
from vellumspark.operators.rules import active_acceptances
from vellumspark.tables import folder_names, full_uri

# The members that tell of a bundle, and those that it must have.
ACCEPTANCE, RUN, OUTPUT = "acceptance.json", "run.json", "final-output.md"
REQUIRED = (RUN, "facts.jsonl", "claims.jsonl", "mechanisms.jsonl", "draft-trace.json", "gate.json")

_RECORD = "run_id string, state string, output string, output_sha256 string, region string, region_sha256 string, finalized_at string, files map<string,string>"


def _hash_files(folder: str):
    from pyarrow.fs import FileSelector, FileSystem, FileType

    schema = pa.schema([(n, pa.string()) for n in ("bundle", "name", "sha256", "content")])

    def run(batches):
        files, base = FileSystem.from_uri(folder)
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                rows = []
                for info in files.get_file_info(FileSelector(f"{base.rstrip('/')}/{bundle}")):
                    if info.type != FileType.File:
                        continue
                    digest, kept = hashlib.sha256(), []
                    with files.open_input_stream(info.path, compression=None) as data:
                        while piece := data.read(1 << 20):
                            digest.update(piece)
                            if info.base_name in (ACCEPTANCE, RUN):
                                kept.append(piece)
                    text = b"".join(kept).decode("utf-8", "replace") if info.base_name in (ACCEPTANCE, RUN) else None
                    rows.append({"bundle": bundle, "name": info.base_name, "sha256": digest.hexdigest(), "content": text})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, name, sha256, content) of the files of each bundle's folder; ``content`` is kept of the two JSON members alone.

    Tasks list and read the bundles, a piece of a file at a time, so files may be of any size, empty or hidden; a bundle without a file gives no row."""
    names = spark.createDataFrame([(n,) for n in folder_names(spark, folder)], "bundle string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(parts, "bundle").mapInArrow(_hash_files(full_uri(spark, folder)), "bundle string, name string, sha256 string, content string")


def _member(name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.col("content")))


def bundle_states(files: DataFrame) -> DataFrame:
    """One row a bundle: (bundle, record, issue, detail); sound ones have a record and no issue.

    The first fault in this order is named: a pending bundle, its acceptance, its manifest, its members, its files'
    checksums, its output, its run."""
    told = files.groupBy("bundle").agg(_member(ACCEPTANCE).alias("acceptance"), _member(RUN).alias("run"))
    read = told.select("bundle", F.from_json("acceptance", _RECORD).alias("record"), F.from_json("acceptance", "map<string,string>").alias("said"), F.from_json("run", "state string, finalization map<string,string>").alias("run"))
    listed = read.select("bundle", F.explode("record.files").alias("name", "expected"))
    met = listed.join(files.select("bundle", "name", "sha256"), ["bundle", "name"], "left")
    odd = ~F.col("name").rlike("^[^/]+$") | F.col("name").isin(".", "..", ACCEPTANCE)
    wrong = met.groupBy("bundle").agg(F.bool_or(odd).alias("odd"), F.min(F.when(~F.col("sha256").eqNullSafe(F.col("expected")), F.col("name"))).alias("wrong"))
    names = F.map_keys("record.files")
    holds = lambda *members: F.size(F.array_except(F.array(*(F.lit(m) for m in members)), names)) == 0
    same = F.forall(F.map_entries("run.finalization"), lambda e: F.coalesce(F.try_element_at(F.col("said"), e["key"]) == e["value"], e["value"].isNull() & F.map_contains_key(F.col("said"), e["key"])))
    yes = lambda test: F.coalesce(test, F.lit(False))
    detail = (
        F.when(~yes(safe_id("bundle") & (F.col("record.state") == "COMMITTED") & (F.col("record.run_id") == F.col("bundle"))), "uncommitted or misidentified archive")
        .when(~yes((F.size("record.files") > 0) & holds(OUTPUT)), "missing archive manifest")
        .when(~yes(holds(*REQUIRED)), "incomplete accepted evidence bundle")
        .when(yes(F.col("odd")), "invalid archive member")
        .when(F.col("wrong").isNotNull(), F.concat(F.lit("artifact checksum mismatch: "), "wrong"))
        .when(~yes(F.col("record.output").isNotNull() & (F.col("record.files")[OUTPUT] == F.col("record.output_sha256"))), "final output checksum mismatch")
        .when(~yes((F.col("run.state") == "COMMITTED") & (F.size("run.finalization") > 0) & same), "archive acceptance does not match committed run")
    )
    pending = F.startswith("bundle", F.lit(".pending-"))
    issue = F.when(pending, "PROVENANCE_PENDING").when(detail.isNotNull(), "PROVENANCE_ARCHIVE_DRIFT")
    return read.join(wrong, "bundle", "left").select("bundle", "record", issue.alias("issue"), F.when(~pending, detail).alias("detail"))


def verified(states: DataFrame) -> DataFrame:
    """The records of sound bundles."""
    return states.where("issue is null").select("record.*")


def bundle_issues(states: DataFrame) -> DataFrame:
    return states.where("issue is not null").select(F.col("issue").alias("kind"), "bundle", "detail")


_ENTRY = ("run_id", "output", "output_sha256", "region", "region_sha256", "finalized_at")


def finalization_entries(records: DataFrame, legacy: DataFrame, runs: DataFrame) -> DataFrame:
    """Acceptances: of archived runs first, and of ``legacy`` ones while no bundle has their run and the run (run_id) is still there."""
    archived = records.select(*_ENTRY)
    usable = legacy.where(safe_id("run_id")).join(archived.select("run_id"), "run_id", "left_anti").join(runs.select("run_id").distinct(), "run_id", "left_semi")
    return archived.unionByName(usable.select(*_ENTRY).dropDuplicates(["run_id"]))


def rebuild_index(states: DataFrame, legacy: DataFrame, runs: DataFrame, folder: str) -> dict:
    """Writes the acceptances as the folder's next version, unless a bundle has an issue; then nothing changes.

    A version is written beside the others and renamed into place at once; readers take the last by :func:`current_index`."""
    spark = states.sparkSession
    faults = bundle_issues(states).count()
    if faults:
        return {"ok": False, "issues": faults}
    entries = finalization_entries(verified(states), legacy, runs)
    versions = _versions(spark, folder)
    if versions:
        now = spark.read.parquet(f"{folder}/{_version(versions[-1])}")
        if entries.exceptAll(now.select(*_ENTRY)).isEmpty() and now.select(*_ENTRY).exceptAll(entries).isEmpty():
            return {"ok": True, "version": versions[-1], "changed": False}
    number = (versions or [0])[-1] + 1
    staged = f"{folder}/.staged-{number}"
    entries.write.mode("overwrite").parquet(staged)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, f"{folder}/{_version(number)}"))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise RuntimeError("another writer made this version of the index")
    return {"ok": True, "version": number, "changed": True}


def _version(number: int) -> str:
    return f"v{number:08d}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[1:]) for n in folder_names(spark, folder) if n[:1] == "v" and n[1:].isdigit())


def current_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_version(_versions(spark, folder)[-1])}")


@F.pandas_udf(T.StringType())
def region_digest_udf(text: pd.Series, region: pd.Series) -> pd.Series:
    def digest(t, r):
        try:
            start, end = region_span(t, r)
        except (ValueError, TypeError):
            return None
        return hashlib.sha256(t[start:end].encode()).hexdigest()

    return pd.Series([digest(t, r) for t, r in zip(text, region)], dtype=object)


def archive_audit(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """(kind, run, output, region): acceptances in force whose output (output, text) is another now, is missing or lost its region."""
    active = active_acceptances(records.select(*_ENTRY)).join(outputs.select("output", "text"), "output", "left")
    now = F.when(F.col("region").isNull(), F.sha2(F.col("text").cast("binary"), 256)).otherwise(region_digest_udf("text", "region"))
    held = active.withColumn("now", now).withColumn("expected", F.when(F.col("region").isNull(), F.col("output_sha256")).otherwise(F.col("region_sha256")))
    kind = F.when(F.col("now").isNull() | F.col("expected").isNull(), "FINALIZATION_OUTPUT_MISSING_OR_INVALID").when(F.col("now") != F.col("expected"), "FINALIZATION_HASH_DRIFT")
    return held.select(kind.alias("kind"), F.col("run_id").alias("run"), "output", "region").where("kind is not null")
