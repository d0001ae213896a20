"""Removal of repeated byte strings by distributed prefix doubling.

Every byte that is covered by a string of ``length`` bytes which also starts
anywhere else goes.  The doubling ranks prefixes of length/2 first and pairs of
ranks at growing offsets after that; a position drops out once its rank is
unique, and ranks past the threshold are not told apart any further:

1. Of the windows (strings of ``length`` bytes) that start in a row, each has a
   core: its length/2-byte piece of the least fingerprint, the leftmost of
   equals.  Equal windows have equal cores at equal offsets, so positions can
   be ranked by their cores' places alone, about one place in 45 bytes.  Spark
   counts the cores; places whose core is unique drop out.
2. The rank grows to the whole stretch that the windows of a place cover (core
   and both sides).  Places of equal stretches repeat in all their windows.
3. Stretches that share a core but differ are ranked window by window, each
   window by its pair of half-length ranks.  One place of each stretch takes
   part; windows of cores with many stretches are dealt by their offset.

Ranks are 64-bit fingerprints of the bytes, so nothing has to be sorted into
dense numbers; different strings get one rank with a chance near 2**-64 a pair.

Defined cases: null text is empty; texts under ``length`` bytes hold no window
and stay whole; repeated rows repeat each other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Fingerprints, discard, materialize, mix, parts, segments, text_bytes

#: Stretches of a core beyond which its windows are dealt by their offset to the
#: core, ``BLOCK`` offsets together, and beyond which one by one.
HOT, HUGE, BLOCK = 64, 1 << 16, 8

_PLACE = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("core", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("lead", T.LongType())])
_PLACE_ARROW = pa.schema([(f.name, pa.int64()) for f in _PLACE])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def places(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, core, stretch, first, last, lead) of a segment's core places: windows
    first to last (starts, in bytes of the row) have the same core place, which
    lies ``lead`` bytes after the first."""
    none = np.zeros(0, np.int64)
    half = length // 2
    prints = Fingerprints(data)
    cores = prints.fixed(half)
    if len(data) < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    ranked = (cores & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(cores), dtype=np.uint64)
    core_at = (sliding_min(ranked, length - half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(core_at)]
    valid = np.arange(len(core_at)) + length <= offsets[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    at, row = core_at[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    k = np.flatnonzero(new)
    first, last = start[k], start[np.append(k[1:], len(start)) - 1]
    at, row = at[k], row[k]
    stretch = prints.ranges(first, last + length) ^ mix(((at - first) << 32 | (last - first)).astype(np.uint64))
    return row, cores[at], stretch, first - offsets[row], last - offsets[row], at - first


def _place_batches(length: int):
    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            for a, b in segments(offsets):
                row, core, stretch, first, last, lead = places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[a + row], keys[a + row], core.view(np.int64), stretch.view(np.int64), first, last, lead)], schema=_PLACE_ARROW)

    return run


_WINDOWS = T.StructType([*(T.StructField(n, T.LongType()) for n in ("id", "h", "core", "stretch", "block", "first")), T.StructField("single", T.BooleanType()), T.StructField("prints", T.ArrayType(T.LongType()))])


def _window_batches(length: int):
    """Fingerprints of the windows of each stretch of a row; block 0 holds them all,
    blocks from 1 those of a few offsets to the core, and block -1 is for huge cores."""

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(k).to_pylist() for k in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            asked = batch.column(3).to_pylist()
            out = [[] for _ in range(8)]
            for a, b in segments(offsets):
                prints = Fingerprints(data[offsets[a] : offsets[b]])
                for k in range(a, b):
                    for s in asked[k]:
                        first, last = s["first"], s["last"]
                        at = np.arange(first, last + 1) + (offsets[k] - offsets[a])
                        found = prints.ranges(at, at + length).view(np.int64)
                        if s["kinds"] <= HOT or s["kinds"] > HUGE:
                            pieces = [(0 if s["kinds"] <= HOT else -1, 0, len(found))]
                        else:
                            block = (s["lead"] - np.arange(len(found))) // BLOCK + 1
                            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(found)]
                            pieces = [(int(block[x]), x, y) for x, y in zip(edges, edges[1:])]
                        for block, x, y in pieces:
                            for column, value in zip(out, (ids[k], keys[k], s["core"], s["stretch"], block, first + x, s["single"], found[x:y])):
                                column.append(value)
                if len(out[0]) > 4096:
                    yield _window_batch(out)
                    out = [[] for _ in range(8)]
            yield _window_batch(out)

    return run


def _window_batch(out):
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_WINDOWS.fieldNames())


_SPAN = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("start", T.LongType()), T.StructField("last", T.LongType())])
_SPAN_ARROW = pa.schema([(f.name, pa.int64()) for f in _SPAN])


def _shared_windows(batches):
    """Runs of windows, of the stretches of one core, that another stretch of it has too."""

    def walk(rows):
        if len(rows) < 2:
            return
        counts = [len(r[5]) for r in rows]
        prints = np.concatenate([r[5] for r in rows])
        owner = np.repeat(np.arange(len(rows)), counts)
        # A stretch holds each window once unless it repeats itself, which counts as well.
        values, code, times = np.unique(prints, return_inverse=True, return_counts=True)
        twice = times[code] > 1
        edge = np.cumsum([0, *counts])
        for k in np.unique(owner[twice]).tolist():
            i, h, _, first, single, _ = rows[k]
            if single:
                own = np.flatnonzero(twice[edge[k] : edge[k + 1]])
                cuts = np.flatnonzero(np.diff(own) > 1)
                for a, b in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(own) - 1]])):
                    yield i, h, first + int(own[a]), first + int(own[b])

    def flush(out):
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SPAN_ARROW)

    current, rows, out, before = None, [], [], None
    for batch in batches:
        prints = batch.column(7)
        flat, edges = prints.flatten().to_numpy(zero_copy_only=False), prints.offsets.to_numpy() - prints.offsets[0].as_py()
        for j, (i, h, core, stretch, block, first, single) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)))):
            if (core, block) != current:
                out += walk(rows)
                current, rows = (core, block), []
            elif stretch == before:  # rows that are alike in id and text
                continue
            before = stretch
            rows.append((i, h, core, first, single, flat[edges[j] : edges[j + 1]].copy()))
        if len(out) > 10_000:
            yield flush(out)
            out = []
    out += walk(rows)
    yield flush(out)


_DIGEST = T.StructType([T.StructField("id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): the byte spans that ``docs`` rows lose, where there are any; ``h`` is the text's xxhash64."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    texts = _texts(docs, id_col, text_col)
    found = texts.mapInArrow(_place_batches(length), _PLACE)
    cores = materialize(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "dedup-cores")
    ranked = materialize(found.join(cores, "core"), "dedup-places")
    discard(spark, cores)
    one = F.min(F.struct("id", "h", "first", "last", "lead"))
    stretches = materialize(ranked.groupBy("core", "stretch").agg(F.count("*").alias("n"), one.alias("one")), "dedup-stretches")
    whole = ranked.join(stretches.where("n > 1").select("core", "stretch"), ["core", "stretch"]).select("id", "h", F.col("first").alias("start"), "last")

    several = stretches.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = stretches.join(several, "core").select("one.*", F.struct("core", "stretch", "one.first", "one.last", "one.lead", (F.col("n") == 1).alias("single"), "kinds").alias("s"))
    asked = asked.groupBy("id", "h").agg(F.collect_list("s").alias("asked"))  # at most one for each place of a text
    windows = materialize(texts.join(asked, ["id", "h"]).select("id", "h", "text", "asked").mapInArrow(_window_batches(length), _WINDOWS), "dedup-windows")
    held = windows.where("block >= 0")
    shared = held.repartition(n_parts, "core", "block").sortWithinPartitions("core", "block", "stretch").mapInArrow(_shared_windows, _SPAN)
    single = windows.where("block < 0").select("id", "h", "core", "stretch", "single", F.posexplode("prints").alias("k", "print"), "first")
    both = single.groupBy("core", "print").agg(F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("lo <> hi").select("core", "print")
    start = F.col("first") + F.col("k")
    hot = single.where("single").join(both, ["core", "print"]).select("id", "h", start.alias("start"), start.alias("last"))
    spans = whole.unionByName(shared).unionByName(hot)
    out = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", (F.col("last") + length).alias("end"))).alias("spans"))
    return materialize(out, "dedup-spans")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _cut(batches):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode()
            own = merged((s["start"], s["end"]) for s in found or [])
            at, pieces = 0, []
            for a, b in own:
                pieces.append(data[at:a])
                at = b
            kept.append(b"".join(pieces) + data[at:])
            spans.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["id", "kept", "spans"])


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, spans) of every row: the bytes that stay (a cut can fall inside
    a character) and the maximal removed byte spans."""
    spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    joined = _texts(docs, id_col, text_col).join(spans, ["id", "h"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(_cut, _DIGEST)
    return out.select(F.nullif("id", F.lit(-(1 << 63))).alias(id_col), "kept", "spans")


def digest_repeats(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query, from :func:`remove_repeats`."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return removed.select(
        id_col, (F.octet_length("kept") + lost).cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
