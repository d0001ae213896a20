"""Exact vector search and rank fusion, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LEARNING_BOOST, DEPTH = 60, 1.10, 20
MIN_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def normalized(v: Column, dimension: int | None = None) -> Column:
    """The first ``dimension`` components, divided by their norm; null if that
    is under 1e-12 or a component is not finite."""
    cut = F.transform(F.slice(v, 1, dimension) if dimension else v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda t, x: t + x * x))
    sound = F.forall(cut, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm >= MIN_NORM)
    return F.when(sound, F.transform(cut, lambda x: x / norm))


def top_vectors(vectors: DataFrame, query: Column, k: int, *, id_col: str, vector_col: str, group_col: str | None = None) -> DataFrame:
    """(id, score, rank): the k nearest by cosine of unit vectors, or the best of
    each group; ties go to the smaller id."""
    scored = vectors.select(id_col, *([group_col] if group_col else []), F.round(dot(F.col(vector_col), query), 5).alias("score"))
    if group_col:
        best = scored.groupBy(group_col).agg(F.max(F.struct("score", (-F.col(id_col)).alias("minus"))).alias("b"))
        scored = best.select(group_col, (-F.col("b.minus")).alias(id_col), F.col("b.score").alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, id_col: str) -> DataFrame:
    """Hits with their rank from 1; meant for top-k results."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, *, id_col: str, boosted: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: sum of 1/(60 + rank), the best
    rank of repeated ids, times 1.1 where ``boosted`` holds."""
    sides = [side.groupBy(id_col).agg(F.min("rank").alias(name)) for side, name in ((lexical, "lexical_rank"), (semantic, "semantic_rank"))]
    both = sides[0].join(sides[1], id_col, "full_outer")
    score = sum((F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0)) for c in ("lexical_rank", "semantic_rank")), F.lit(0.0))
    if boosted is not None:
        score = score * F.when(boosted, LEARNING_BOOST).otherwise(1.0)
    return both.select(id_col, "lexical_rank", "semantic_rank", F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def retrieval_metrics(ranked_hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row of cases, mean_recall, mrr and passed from (case_id, id, rank) hits
    and (case_id, id) expectations."""
    found = expected.join(ranked_hits.where(F.col("rank") <= k), ["case_id", "id"], "left")
    cases = found.groupBy("case_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("reciprocal"))
    return cases.agg(
        F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("reciprocal"), 6).alias("mrr"), F.sum((F.col("recall") == 1).cast("long")).alias("passed")
    )
