"""Benchmark decontamination by an FM-index per training shard.

Words of a shard of documents become integer symbols; its FM-index answers for
every benchmark window, by backward search through wavelet-tree ranks, which
suffixes begin with it, and sampled suffix positions say where.  The hit
stretches of words are merged into removal spans.

The alphabet of an index is the benchmark's vocabulary: a word outside it can
stand in no occurrence, so it only separates runs, and runs that are shorter
than the shortest window are left out.  That loses no occurrence and keeps an
index small.  Shards have a bounded number of bytes, and a benchmark beyond
``BLOCK_BYTES`` is searched in several blocks of items, one after the other.

A word that has the fingerprint of a benchmark word is compared with it byte by
byte.

Defined cases: null has no words and no windows; an item of fewer words than a
window is one window, an item without words none; items with one id are one
item, and so are those without an id, which count but are not named; repeated
documents give repeated results; very long texts form a shard of their own;
windows that overlap or touch make one span; an empty table on either side
gives no hits; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_BREAK, free_name, frugal, lowered, segments, text_bytes, word_hashes, word_spans
from .fm_index import FMIndex

WINDOW = 10
#: Text that one shard holds, and symbols of one index.
SHARD_BYTES, SHARD_SYMBOLS = 16 << 20, 1 << 20
#: Benchmark text that is searched at once.
BLOCK_BYTES = 8 << 20

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")]))
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "start", "end")]))


class Windows:
    """The windows of benchmark items as symbols of their vocabulary.

    ``by_length`` has for each window length the distinct windows (a row each) and their items: those of window k
    are ``owners[edges[k]:edges[k + 1]]``, numbers into ``items``."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        self.items = [item for item, _ in items]
        data, offsets = text_bytes(pa.array([text for _, text in items], pa.string()))
        data = lowered(data)
        start, end, row = word_spans(data, offsets, ALNUM_BREAK)
        hashes = word_hashes(data, start, end)
        self.hashes, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        #: The words themselves, to be compared where a fingerprint agrees.
        self.data, self.start, self.end = data, start[first], end[first]
        if not self.same(np.arange(len(hashes)), code, data, start, end).all():
            raise ValueError("two words of the benchmark share a fingerprint")
        #: Cheap first test of a hash by its low bits.
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        symbols, counts = (code + 1).astype(np.int32), np.bincount(row, minlength=len(items))
        begin = np.cumsum(counts) - counts
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(counts[counts > 0], width)).tolist():
            if length == width:
                at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            else:
                at = begin[counts == length]
            windows, owner = symbols[at[:, None] + np.arange(length)], row[at]
            by = np.lexsort((owner, *windows.T))
            windows, owner = windows[by], owner[by]
            other = np.ones(len(by), bool)
            other[1:] = (windows[1:] != windows[:-1]).any(1)
            fresh = other.copy()
            fresh[1:] |= owner[1:] != owner[:-1]
            number = np.cumsum(other) - 1
            edges = np.searchsorted(number[fresh], np.arange(number[-1] + 2))
            self.by_length[length] = (windows[other], edges, owner[fresh])
        self.shortest = min(self.by_length, default=0)

    def same(self, which: np.ndarray, code: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the words ``which`` of a text are the words ``code`` of the vocabulary, byte by byte."""
        own, size = start[which], end[which] - start[which]
        alike = size == self.end[code] - self.start[code]
        k = np.flatnonzero(alike)
        inside = np.arange(size[k].sum()) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
        wrong = data[np.repeat(own[k], size[k]) + inside] != self.data[np.repeat(self.start[code[k]], size[k]) + inside]
        alike[k[np.repeat(np.arange(len(k)), size[k])[wrong]]] = False
        return alike

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbols of the words of a text; 0 for those outside the vocabulary."""
        hashes = word_hashes(data, start, end)
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == hashes[maybe]
            maybe, at = maybe[right], at[right]
            right = self.same(maybe, at, data, start, end)
            out[maybe[right]] = at[right] + 1
        return out


class Shard:
    """Rows of documents on their way to one FM-index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.n_words: list[np.ndarray] = []
        self.runs: list[tuple[np.ndarray, ...]] = []  # symbol, row, word, start, end
        self.rows = self.symbols = self.bytes = 0

    def add(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        for a, b in segments(offsets):
            part, edge = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            start, end, row = word_spans(part, edge, ALNUM_BREAK)
            counts = np.bincount(row, minlength=b - a).astype(np.int64)
            self.n_words.append(counts)
            if len(start) and self.windows.shortest:
                symbol = self.windows.encode(part, start, end)
                inside = symbol > 0
                new = inside.copy()
                new[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
                run = np.cumsum(new)
                sizes = np.bincount(run[inside], minlength=int(run[-1]) + 1)
                keep = np.flatnonzero(inside & (sizes[run] >= self.windows.shortest))
                if len(keep):
                    points = np.zeros(len(part) + 1, np.int64)
                    np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                    origin = points[edge[row[keep]]]
                    first = np.cumsum(counts) - counts
                    self.runs.append((symbol[keep], row[keep] + self.rows, keep - first[row[keep]], points[start[keep]] - origin, points[end[keep]] - origin))
                    self.symbols += len(keep)
            self.rows += b - a
            self.bytes += len(part)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.symbols >= SHARD_SYMBOLS

    def search(self) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]], dict[int, set[int]]]:
        """Words of each row; merged hit spans and (numbers of) items of the rows that have any."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        spans: dict[int, list] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        if not self.runs:
            return n_words, spans, items
        symbol, row, word, start, end = (np.concatenate(c) for c in zip(*self.runs))
        # A separator goes before each run and at the end.
        new = np.ones(len(symbol), bool)
        new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)
        place = np.arange(len(symbol)) + np.cumsum(new)
        text = np.zeros(place[-1] + 2, np.int32)
        text[place] = symbol
        back = np.full(len(text), -1, np.int64)
        back[place] = np.arange(len(symbol))
        index = FMIndex(text)
        cover = np.zeros(len(text) + 1, np.int64)
        for length, (patterns, edges, owners) in self.windows.by_length.items():
            low, high = index.search(patterns)
            sizes = high - low
            hit = np.flatnonzero(sizes)
            if not len(hit):
                continue
            which = np.repeat(hit, sizes[hit])
            rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes[hit]) - sizes[hit], sizes[hit]) + low[which]
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            pairs = np.unique(np.stack([row[back[at]], which], 1), axis=0)
            for r, w in pairs.tolist():
                items[r].update(owners[edges[w] : edges[w + 1]].tolist())
        covered = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        if len(covered):
            k = back[covered]
            begins = np.ones(len(k), bool)
            begins[1:] = (row[k[1:]] != row[k[:-1]]) | (word[k[1:]] != word[k[:-1]] + 1)
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(k)) - 1
            for a, b in zip(k[first].tolist(), k[last].tolist()):
                spans[int(row[a])].append((int(word[a]), int(word[b]) + 1, int(start[a]), int(end[b])))
        return n_words, spans, items


def merge_spans(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans by place, those that touch or overlap in words as one."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], span[1]), last[2], max(last[3], span[3]))
        else:
            out.append(span)
    return out


def cut(text: str | None, spans) -> str | None:
    if not spans:
        return text
    pieces, at = [], 0
    for span in spans:
        pieces.append(text[at : span["start"]])
        at = span["end"]
    return "".join(pieces) + text[at:]


def _pass(shared, width: int, text_at: int, before: bool, cutting: bool = False):
    """One block of items against all rows; with ``before``, the last three columns hold what earlier blocks found.
    With ``cutting``, the spans are cut from the text instead of being returned."""
    names = ("first_word", "end_word", "start", "end")

    def flush(windows, batches, shard):
        n_words, spans, items = shard.search()
        at = 0
        for batch in batches:
            n = batch.num_rows
            new_spans = [spans.get(at + k, []) for k in range(n)]
            new_items = [{windows.items[i] for i in items.get(at + k, ())} for k in range(n)]
            kept = list(range(batch.num_columns - 3 * before))
            if before:
                for k, (old, own) in enumerate(zip(batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist())):
                    new_spans[k] = merge_spans(new_spans[k] + [tuple(s[x] for x in names) for s in old])
                    new_items[k].update(own)
            if cutting:
                columns = [batch.column(k) for k in kept]
                if any(new_spans):
                    columns[text_at] = pa.array([cut(t, [dict(zip(names, s)) for s in own]) for t, own in zip(columns[text_at].to_pylist(), new_spans)], pa.string())
                yield columns
                at += n
                continue
            found = [
                pa.array(n_words[at : at + n], pa.int64()),
                pa.array([[dict(zip(names, s)) for s in own] for own in new_spans], _SPANS),
                pa.array([sorted(own, key=lambda i: (i is None, i)) for own in new_items], pa.list_(pa.string())),
            ]
            yield [batch.column(k) for k in kept] + found
            at += n

    def run(batches):
        windows = Windows(shared.value, width)
        held, shard = [], Shard(windows)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                shard.add(piece.column(text_at))
                held.append(piece)
                if shard.full():
                    yield from flush(windows, held, shard)
                    held, shard = [], Shard(windows)
        yield from flush(windows, held, shard)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cutting: bool = False) -> DataFrame:
    """With ``cutting``, ``docs`` without the hit spans; else ``docs`` and three more columns, the last ones: the number of words, the merged hit spans (word numbers and
    code points, ends exclusive) and the items with occurring windows.  They are called ``_n_words``, ``_spans`` and
    ``_items``, with more underscores where ``docs`` has such a column."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    kinds = {"_n_words": T.LongType(), "_spans": SPANS, "_items": T.ArrayType(T.StringType())}
    names = [free_name(name, docs.columns) for name in kinds]
    out = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(names, kinds.values()))])
    text_at, schema = docs.columns.index(text_col), docs.schema
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = [(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()]  # about BLOCK_BYTES
        last = cutting and block == blocks - 1
        step = _pass(spark.sparkContext.broadcast(rows), width, text_at, block > 0, last)
        result = schema if last else out
        docs = docs.mapInArrow(frugal(named(step, result.names)), result)
    return docs


def named(step, names: list[str]):
    """A step over batches that yields lists of columns, with their names."""

    def run(batches):
        for columns in step(batches):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def digest_contamination(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query, from :func:`find_contamination`."""
    n_words, spans, items = (F.col(f"`{name}`") for name in found.columns[-3:])
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end_word"] - s["first_word"])
    return found.select(
        id_col,
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with the hit spans cut from the text and its length brought up to date."""
    schema = docs.schema
    out = find_contamination(docs, benchmark, text_col=text_col, cutting=True, **options)
    if count_col in schema.fieldNames():
        out = out.withColumn(count_col, F.when(F.col(count_col).isNotNull(), F.length(text_col)).cast(schema[count_col].dataType))
    return out
