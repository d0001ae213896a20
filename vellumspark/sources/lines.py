"""Text files as numbered lines, read in splits.

Spark reads a large file in several splits, none of which knows how many lines stand before it.  The lines of each
split are counted first; running sums over these few counts give the number that each split begins with.  No file is one string.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.tables import written

#: What ends a line besides the line feed and carriage return at which files are split.
OTHER_ENDS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]"


def numbered_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(file, number, line) of text files, numbers from 1.

    A line feed ends a line, alone or behind a carriage return, and so do a lone carriage return and the other line ends
    of Unicode.  A last line without an end counts; one of those others at the very end of a file opens an empty line; an
    empty file has no line.  ``options`` go to the reader (``pathGlobFilter`` and so on)."""
    read = spark.read.options(**options).text(path)
    ended = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.explode(F.split("value", OTHER_ENDS)).alias("line"))
    lines = written(ended.withColumn("place", F.monotonically_increasing_id()), "lines")
    counted = lines.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("file", "start", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))
    return lines.join(base, ["file", "start"]).select("file", (F.col("base") + F.col("place")).alias("number"), "line")


def line_counts(lines: DataFrame) -> DataFrame:
    """(file, lines)."""
    return lines.groupBy("file").agg(F.max("number").alias("lines"))


def _digest_files(batches):
    schema = pa.schema([("file", pa.string()), ("sha256", pa.string())])
    current, digest = None, None
    for batch in batches:
        done = []
        for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if file != current:
                if digest:
                    done.append((current, digest.hexdigest()))
                current, digest = file, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], schema=schema)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], schema=schema)


def file_digests(lines: DataFrame) -> DataFrame:
    """(file, sha256) of each file's lines joined by line feeds; a digest is made in one go, so a file is one task's work, line by line."""
    ordered = lines.select("file", "line", "number").repartition("file").sortWithinPartitions("file", "number")
    return ordered.select("file", "line").mapInArrow(_digest_files, "file string, sha256 string")
