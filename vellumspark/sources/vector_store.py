"""Building and reading vector indexes: a pluggable embedder, validation, a meta row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.vectors import normalized

#: Texts of one call to an embedder.
BATCH = 32
SCHEMA_VERSION = 2

Embedder = Callable[[list[str]], list[list[float]]]


def embed(chunks: DataFrame, embedder: Embedder, *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, vector): texts go to the embedder in batches of ``BATCH``, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), BATCH):
                part = batch.iloc[k : k + BATCH]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": embedder(part["text"].tolist())})

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, vector array<double>").withColumnRenamed("id", id_col)


def corpus_digest(chunks: DataFrame, id_col: str = "chunk_id", hash_col: str = "content_hash") -> str:
    """sha256 over the chunks' ids and digests, whatever their order."""
    row = chunks.select(F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(hash_col)), 256).alias("d"))
    # A sum of digests needs no gathering: it is the same for any order and partition.
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return row.agg(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *parts), 256)).first()[0]


def build_index(chunks: DataFrame, embedder: Embedder, path: str, *, provider: str, model: str, dimension: int | None = None, id_col: str = "chunk_id") -> dict:
    """Embeds, validates, truncates and normalizes; writes vectors and a meta row.

    Gives ``{"status": "built" | "empty" | "unavailable"}``; an empty corpus or a
    vector that can't be normalized leaves no index behind."""
    spark = chunks.sparkSession
    vectors = embed(chunks, embedder, id_col=id_col).withColumn("unit", normalized(F.col("vector"), dimension))
    try:
        vectors.select(id_col, "unit").write.mode("overwrite").parquet(f"{path}/vectors")
    except Exception as error:
        _remove(spark, path)
        return {"status": "unavailable", "reason": str(error)[:300]}
    stored = spark.read.parquet(f"{path}/vectors")
    found = stored.agg(F.count("*").alias("n"), F.count("unit").alias("sound"), F.min(F.size("unit")).alias("lo"), F.max(F.size("unit")).alias("hi")).first()
    if not found["n"]:
        _remove(spark, path)
        return {"status": "empty"}
    if found["sound"] != found["n"] or found["lo"] != found["hi"]:
        _remove(spark, path)
        return {"status": "unavailable", "reason": "vectors differ in size or can't be normalized"}
    meta = {"schema_version": SCHEMA_VERSION, "provider": provider, "model": model, "dimension": int(found["lo"]), "chunks": int(found["n"]), "corpus": corpus_digest(chunks, id_col)}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return {"status": "built", **meta}


def read_index(chunks: DataFrame, path: str, *, provider: str, model: str, id_col: str = "chunk_id") -> tuple[DataFrame | None, str]:
    """The vectors, or None with what is wrong: missing, changed settings, stale
    corpus, another size."""
    spark = chunks.sparkSession
    try:
        meta = spark.read.json(f"{path}/meta").first()
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception:
        return None, "missing"
    if (meta["schema_version"], meta["provider"], meta["model"]) != (SCHEMA_VERSION, provider, model):
        return None, "changed settings"
    if meta["corpus"] != corpus_digest(chunks, id_col):
        return None, "stale corpus"
    if vectors.count() != meta["chunks"] or vectors.where(F.size("unit") != meta["dimension"]).limit(1).count():
        return None, "another size"
    return vectors, ""


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
