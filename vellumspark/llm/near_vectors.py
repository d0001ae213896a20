"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one class with a weight.  Spherical k-means, fitted on a
bounded sample (``FIT_ROWS`` rows by the hash of their ids), gives the cells;
every class goes into its ``PROBES`` nearest cells and is compared there with
the others by blocked double-precision products.  A pair that shares several
cells counts in the first of them.  A cell's blocks are compared two by two in
tasks of their own, so a cell of any size never meets in one task; blocks emit
counts and a spanning forest of their links, not the pairs.

Two vectors of a cosine of 0.9 or more can still share no cell; measured
against brute force the recall of links is above 0.99 (see the README).

Defined cases: null or zero vectors and vectors with null or non-finite
components are their own components without links, and so are vectors of
another length than most have; equal vectors link with each other whatever
their rounding; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parts
from .components import connected_components

FIT_ROWS, CELL_ROWS, MAX_CELLS = 8192, 4096, 1024
PROBES, BLOCK, ROUNDS = 4, 2048, 8


def cell_count(total: int) -> int:
    """Cells of ``CELL_ROWS / PROBES`` vectors each.  With so few of them that probing compares as many pairs as all
    vectors have, one cell holds all."""
    cells = min(MAX_CELLS, total * PROBES // CELL_ROWS)
    return cells if cells > PROBES * PROBES else 1


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means; starts from evenly spaced rows."""
    cells = max(1, min(cells, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    return centroids


_CELL = T.StructType([T.StructField("id", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("unit", T.BinaryType())])


def _assign(shared):
    """Nearest cells, nearest first, and the unit vector of each row."""

    def run(batches):
        centroids = shared.value
        for batch in batches:
            vectors = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            cells = np.zeros((0, 1), np.int32)
            if len(vectors):
                # Scaled by the largest component first, as squares could over- or underflow.
                vectors = vectors / np.abs(vectors).max(1, keepdims=True)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                cells = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :PROBES].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int32())), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["id", "weight", "cells", "unit"]
            )

    return run


_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (x[k], y[k]) of rows connect."""
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[min(a, b)]), int(ids[max(a, b)])))
    return out


def _compare(threshold: float):
    """Blocks of one cell: (id, null, links) counts and (a, b, null) forest edges."""

    def walk(cell, first, second, rows):
        rows.sort(key=lambda r: (r[0], r[1]))
        ids = np.array([r[1] for r in rows], np.int64)
        weight = np.array([r[2] for r in rows], np.int64)
        cells = np.array([r[3] for r in rows], np.int32)
        units = np.stack([np.frombuffer(r[4], np.float64) for r in rows])
        part = np.array([r[0] for r in rows])
        left = np.flatnonzero(part == first)
        right = np.flatnonzero(part == second)
        links = np.zeros(len(rows), np.int64)
        xs, ys = [], []
        for a in range(0, len(left), 512):
            own = left[a : a + 512]
            x, y = np.nonzero(units[own] @ units[right].T >= threshold)
            x, y = own[x], right[y]
            if first == second:
                keep = x < y
                x, y = x[keep], y[keep]
            if not len(x):
                continue
            # The pair counts here unless a cell of a lower number is shared as well.
            lower = np.zeros(len(x), bool)
            for p in range(cells.shape[1]):
                for q in range(cells.shape[1]):
                    lower |= (cells[x, p] == cells[y, q]) & (cells[x, p] < cell)
            x, y = x[~lower], y[~lower]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            xs.append(x)
            ys.append(y)
        if xs:
            edges = _forest(ids, np.concatenate(xs), np.concatenate(ys))
            some = np.flatnonzero(links)
            a = [*ids[some].tolist(), *(e[0] for e in edges)]
            b = [*[None] * len(some), *(e[1] for e in edges)]
            c = [*links[some].tolist(), *[None] * len(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, c)], schema=_FOUND_ARROW)

    def run(batches):
        current, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for cell, first, second, part, i, w, cs, unit in zip(*columns):
                if (cell, first, second) != current:
                    if rows:
                        yield from walk(*current, rows)
                    current, rows = (cell, first, second), []
                rows.append((part, i, w, cs, unit))
        if rows:
            yield from walk(*current, rows)

    return run


def near_vectors(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    n_parts = parts(spark)
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    # -0.0 and 0.0 are one value.
    values = F.transform(values, lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), values).alias("v"))
    sound = rows.where("v is not null")
    width = sound.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if width is None:
        return alone
    sound = sound.where(F.size("v") == width["w"])
    key = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)
    keyed = materialize(sound.select("id", "v", key.alias("key")), "vectors")
    classes = materialize(keyed.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("weight")), "vector-classes")
    total = classes.count()
    cells = cell_count(total)
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()], np.float64)
    sample /= np.abs(sample).max(1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(fit_cells(sample, cells))  # at most MAX_CELLS centroids
    placed = materialize(classes.select("id", "weight", "v").mapInArrow(_assign(shared), _CELL), "vector-cells")
    spread = placed.withColumn("cell", F.explode("cells"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sized = spread.join(F.broadcast(spread.groupBy("cell").agg(F.count("*").alias("size"))), "cell").withColumn("part", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # A block meets each block of its cell.
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("cell", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "id", "weight", "cells", "unit")
    dealt = met.repartition(n_parts, "cell", "first", "second").sortWithinPartitions("cell", "first", "second", "id")
    found = materialize(dealt.mapInArrow(_compare(threshold), _FOUND), "vector-links")
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    named = classes.select("key", F.col("id").alias("rep"), "weight").join(links, "rep", "left").join(components, "rep", "left")
    named = named.select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("id", "key").join(named, "key")
    good = linked.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    odd = rows.where(F.col("v").isNull() | (F.size("v") != width["w"]))
    odd = odd.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(odd)
