"""Add-0.1 unigram scores of words, counted over all training documents.

Words travel packed: a pack of documents asks each bucket of word fingerprints
for the counts of its distinct words, giving its own training counts; the
answers come back to the pack in the order of the question.  A word is asked
for once a pack, however many documents hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BREAK, lowered, materialize, parts, segments, text_bytes, word_hashes, word_spans

SMOOTHING = 0.1
PACK_BYTES = 1 << 20

_COLUMNS = ("bucket", "pack", "a", "b", "c", "d")
_PACK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("pack", T.StringType()), *(T.StructField(n, T.BinaryType()) for n in _COLUMNS[2:])])
_PACK_ARROW = pa.schema([("bucket", pa.int32()), ("pack", pa.string()), *((n, pa.binary()) for n in _COLUMNS[2:])])


def _batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * len(_PACK_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACK_ARROW)], schema=_PACK_ARROW)


def _packs(buckets: int):
    """For each pack one row of bucket -1 with its rows (a: ids, keys, words) and
    their postings (b: row, c: times, d: number of the word), and one row for
    each bucket with words (a) and training counts (b)."""

    def flush(name, ids, keys, train, sizes, words):
        sizes = np.concatenate(sizes)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        value = np.concatenate(words)
        order = np.argsort(value, kind="stable")  # rows stay in order
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(value))).astype(np.int32)
        value, row = value[first], row[first]
        fresh = np.ones(len(value), bool)
        fresh[1:] = value[1:] != value[:-1]
        word = np.flatnonzero(fresh)
        distinct = value[word]
        bucket = (distinct >> np.uint64(33)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        head = np.stack([np.array(ids, np.int64), np.array(keys, np.int64), sizes.astype(np.int64)])
        yield -1, name, head.tobytes(), row.tobytes(), times.tobytes(), number[np.cumsum(fresh) - 1].tobytes()
        if not len(word):
            return
        counts = np.add.reduceat(times.astype(np.int64) * np.array(train)[row], word)
        edge = np.searchsorted(bucket[by], np.arange(buckets + 1).astype(np.uint64))
        for k in range(buckets):
            own = by[edge[k] : edge[k + 1]]
            if len(own):
                yield k, name, distinct[own].tobytes(), counts[own].tobytes(), None, None

    def run(batches):
        context, number = TaskContext.get(), 0
        ids, keys, train, sizes, words, held = [], [], [], [], [], 0
        for batch in batches:
            own = [batch.column(k).to_pylist() for k in range(3)]
            data, offsets = text_bytes(batch.column(3))
            for a, b in segments(offsets):
                part, edge = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                start, end, row = word_spans(part, edge, SPACE_BREAK)
                ids += own[0][a:b]
                keys += own[1][a:b]
                train += own[2][a:b]
                sizes.append(np.bincount(row, minlength=b - a))
                words.append(word_hashes(part, start, end) if len(start) else np.zeros(0, np.uint64))
                held += len(part)
                if held >= PACK_BYTES:
                    yield _batch(list(flush(f"{context.partitionId()}-{number}", ids, keys, train, sizes, words)))
                    ids, keys, train, sizes, words, held = [], [], [], [], [], 0
                    number += 1
        if ids:
            yield _batch(list(flush(f"{context.partitionId()}-{number}", ids, keys, train, sizes, words)))

    return run


def _count(batches):
    """The counts that each pack asked for; per bucket, a row of bucket -2 with
    its distinct and all training words."""

    def walk(bucket, packs):
        words = [np.frombuffer(p[1], np.uint64) for p in packs]
        values, code = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, code, np.concatenate([np.frombuffer(p[2], np.int64) for p in packs]))
        yield -2, "", b"%d" % (total > 0).sum(), b"%d" % total.sum(), None, None
        at = 0
        for (name, *_), own in zip(packs, words):
            yield bucket, name, total[code[at : at + len(own)]].tobytes(), None, None, None
            at += len(own)

    current, packs = None, []
    for batch in batches:
        rows = []
        for bucket, name, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if bucket < 0:
                rows.append((bucket, name, a, b, c, d))
                continue
            if bucket != current:
                if packs:
                    yield _batch(list(walk(current, packs)))
                current, packs = bucket, []
            packs.append((name, a, b))
        yield _batch(rows)
    if packs:
        yield _batch(list(walk(current, packs)))


_SUMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("words", T.LongType()), T.StructField("known", T.LongType()), T.StructField("logs", T.DoubleType())])


def _add_up(batches):
    def walk(rows):
        _, head, row, times, number = next(r for r in rows if r[0] == -1)
        ids, keys, sizes = np.frombuffer(head, np.int64).reshape(3, -1)
        row, times, number = (np.frombuffer(x, np.int32) for x in (row, times, number))
        answers = [np.frombuffer(r[1], np.int64) for r in sorted((r for r in rows if r[0] >= 0), key=lambda r: r[0])]
        total = np.concatenate([*answers, np.zeros(0, np.int64)])[number]
        logs = np.bincount(row, weights=times * np.log10(total + SMOOTHING), minlength=len(ids)).astype(np.float64)
        known = np.bincount(row, weights=times * (total > 0), minlength=len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(sizes), pa.array(known), pa.array(logs)], names=_SUMS.fieldNames())

    current, rows = None, []
    for batch in batches:
        for bucket, name, *rest in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if name != current:
                if rows:
                    yield walk(rows)
                current, rows = name, []
            rows.append((bucket, *rest))
    if rows:
        yield walk(rows)


def unigram_sums(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """From (id, h, train, text): (id, h, words, known, logs) of every row, with
    logs the sum of log10(c + 0.1) over its words; distinct and all training words."""
    n_parts = parts(texts.sparkSession)
    packed = texts.mapInArrow(_packs(2 * n_parts), _PACK)
    # Rows of bucket -1 only pass through; they are dealt by their pack.
    key = F.when(F.col("bucket") < 0, F.xxhash64("pack")).otherwise(F.col("bucket").cast("long"))
    counted = materialize(packed.repartition(n_parts, key).sortWithinPartitions("bucket").mapInArrow(_count, _PACK), "unigram")
    found = counted.where("bucket = -2").agg(*(F.sum(F.col(c).cast("string").cast("decimal(38,0)")) for c in "ab")).first()
    rest = counted.where("bucket <> -2")
    sums = rest.repartition(n_parts, "pack").sortWithinPartitions("pack").mapInArrow(_add_up, _SUMS)
    return sums, int(found[0] or 0), int(found[1] or 0)
