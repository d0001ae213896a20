"""A training corpus from raw documents, in five stages.

Each stage takes the rows its predecessor kept and returns a DataFrame that is
written as Parquet and read again for the next one:

1. toxicity: documents that the classifier rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group of near duplicates the document with the
   smallest id stays (rows without an id are compared with nothing);
3. benchmark decontamination: passages of the benchmark are cut from the texts;
4. secret scans: secrets are replaced by a mark;
5. mixing: each document gets a rate and whole copies that bring the expected
   tokens of the domains to their targets.

Defined cases: null and empty texts stay, with no words to compare or cut; very
long texts are read whole by each stage; rows of one id and one text are one
row from stage 2 on, rows of one id and several texts are one document, whose
texts stay or go together; of a group the least id stays; empty tables give an
empty result; further columns are kept up to stage 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from vellumspark.llm.common import free_name, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.fit_rows(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = jaccard_join.jaccard_components(docs, width=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    hash_ = free_name("hash", docs.columns)
    one = docs.withColumn(hash_, F.xxhash64("text")).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", hash_])
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
