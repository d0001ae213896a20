"""Exact Jaccard join of word-shingle sets with set-relation skipping.

* Sets: 64-bit fingerprints of distinct word shingles.  Equal sets are one
  class and are compared once.
* Index: a set of n shingles goes into the lists of its first
  n - ceil(t n) + 1 shingles, which any partner shares one of; shingles that
  many sets hold come last in that order (their counts are of all documents).
* Block skipping: a list is ordered by set size and broken wherever the next
  size is out of reach; within a block, positions bound the overlap, and a
  member that no other can reach is skipped.  Lists with the same smallest
  member (by signature), and then those with one leader, are walked as one
  list of all their members.
* Bitmaps: parities of a set's shingles in n cells or so bound what two sets
  share.  Members of a list that they leave no partner take no part in its walk.
* Answers from a similar set: a walk has the sets of its list and finds for a
  set its overlaps with all others of the list.  If a set X is close to a set L
  whose overlaps are known, those of X are L's, less the lists of the shingles
  that only L has, plus the lists of those that only X has.  A set whose whole
  block is connected with it by now is skipped.
* A walk gives a forest of its links, so what leaves a list grows with its
  members and not with their pairs.

A list beyond ``MEMBERS`` sets or ``SHINGLES`` shingles is dealt by hash to
chunks, which are walked alone.  Then, for lists whose members lie in several
components by now, every member outside the largest of them meets all chunks.
That compares whatever is not connected, so no link between components is lost.

Defined cases: null or empty text (or one without words) has no set, size 0,
and is linked with nothing; fewer words than a shingle make one shingle of all;
very long texts are whole sets like others; repeated rows are one class; of
equal sizes the smaller signature comes first, which no result depends on; an
empty table gives an empty result; extra columns are ignored.  Rows that share
an id are one document, linked with what any of them is linked with.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BREAK, discard, frugal, lowered, materialize, mix, parts, segments, text_bytes, word_hashes, word_spans, worker_forgets
from .components import connected_components

#: Distinct shingles of most sets, at most, whose order is by their count.
HEAVY = 1 << 17
#: Sets and shingles of a list that one walk takes at once; a single set may be larger.
MEMBERS, SHINGLES = 2048, 1 << 20
#: Sets of a walk whose overlaps are kept for similar ones.
KEPT = 16
#: Text whose postings travel together.
PACK_BYTES = 8 << 20

_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def shingle_sets(column: pa.Array, width: int):
    """(sizes, edges, shingles): the sorted set of each row of one segment."""
    data, offsets = text_bytes(column)
    for a, b in segments(offsets):
        part, edge = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, edge, SPACE_BREAK)
        rows = b - a
        counts = np.bincount(row, minlength=rows)
        if not len(start):
            yield a, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64)
            continue
        words = word_hashes(part, start, end)
        full = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :]) if len(row) >= width else np.zeros(0, np.int64)
        value = np.zeros(len(full), np.uint64)
        for k in range(width):
            value += words[full + k] * (_ODD[k % 4] + np.uint64(2 * (k // 4)))
        value = mix(value)
        owner = row[full]
        first = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                inside = counts[short] > k
                whole[inside] += words[first[short[inside]] + k] * (_ODD[k % 4] + np.uint64(2 * (k // 4)))
            whole = mix(whole + counts[short].astype(np.uint64))
            value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
            by = np.argsort(owner, kind="stable")
            value, owner = value[by], owner[by]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield a, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int64), value


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bitmap_bits(n: int) -> int:
    return min(1 << 16, max(64, 1 << max(0, int(n) - 1).bit_length()))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of ``bitmap_bits`` cells."""
    bits = bitmap_bits(len(shingles))
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(map_: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes; parities add up."""
    return np.bitwise_xor.reduce(np.frombuffer(map_, np.uint8).reshape(-1, size), axis=0)


def partnered(sizes: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Which members of a list, in order of size, the bitmaps leave a possible partner: sets of n and m shingles
    that differ in h cells share (n + m - h) / 2 at most."""
    found = np.zeros(len(sizes), bool)
    reach = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    at: dict[int, np.ndarray] = {}
    for k in range(len(sizes)):
        block = np.arange(k + 1, reach[k])
        if found[k]:
            block = block[~found[block]]
        if not len(block):
            continue
        width = len(maps[k])
        if width not in at:
            at = {width: np.stack([fold(m, width) if len(m) >= width else np.zeros(width, np.uint8) for m in maps])}
        n, m = int(sizes[k]), sizes[block]
        h = np.bitwise_count(at[width][block] ^ at[width][k]).sum(1, dtype=np.int64)
        shared = np.minimum((n + m - h) // 2, n)
        match = block[100 * shared >= percent * (n + m - shared)]
        if len(match):
            found[k] = found[match] = True
    return found


class Walk:
    """The sets of one list; ``edges`` connects what links between them connect.

    Members with ``wanted`` false meet only members with it true; ``group`` has the components known before."""

    def __init__(self, shingles: list[np.ndarray], percent: int, group: np.ndarray, wanted: np.ndarray):
        self.percent = percent
        self.n = np.array([len(s) for s in shingles], np.int64)
        self.order = np.argsort(self.n, kind="stable")
        self.n = self.n[self.order]
        self.wanted = wanted[self.order]
        self.group = np.unique(group[self.order], return_inverse=True)[1]
        flat = np.concatenate([shingles[k] for k in self.order])
        owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        by = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[by[1:]] != flat[by[:-1]]
        self.local = np.empty(len(flat), np.int64)
        self.local[by] = np.cumsum(new) - 1
        self.first = np.cumsum(self.n) - self.n
        #: Members of each shingle, one shingle after the other.
        self.members, self.edge = owner[by], np.append(np.flatnonzero(new), len(flat))

    def own(self, k: int) -> np.ndarray:
        return self.local[self.first[k] : self.first[k] + self.n[k]]

    def counts(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each member has."""
        start, size = self.edge[shingles], self.edge[shingles + 1] - self.edge[shingles]
        at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        return np.bincount(self.members[at], minlength=len(self.n))

    def edges(self):
        """Pairs of places in the list given."""
        total = len(self.n)
        reach = np.searchsorted(self.n, self.n * 100 // self.percent, side="right")
        kept: list[tuple[int, np.ndarray]] = []  # members and their overlaps with all
        for k in range(total):
            block = slice(k + 1, reach[k])
            open_ = self.group[block] != self.group[k]
            if not self.wanted[k]:
                open_ &= self.wanted[block]
            if not open_.any():
                continue
            near, apart = None, self.n[k]
            for leader, overlaps in kept:
                if (d := self.n[leader] + self.n[k] - 2 * overlaps[k]) < apart:
                    near, apart = (leader, overlaps), d
            own = self.own(k)
            if near is None:
                overlaps = self.counts(own)
                kept = [(k, overlaps), *kept[: KEPT - 1]]
            else:
                theirs = self.own(near[0])
                overlaps = near[1] - self.counts(np.setdiff1d(theirs, own, True)) + self.counts(np.setdiff1d(own, theirs, True))
            shared = overlaps[block]
            linked = open_ & (100 * shared >= self.percent * (self.n[k] + self.n[block] - shared))
            for j in (np.flatnonzero(linked) + k + 1).tolist():
                if self.group[j] != self.group[k]:
                    self.group[self.group == self.group[j]] = self.group[k]
                    yield int(self.order[k]), int(self.order[j])


# --------------------------------------------------------------------------
# Passes over the documents

_SCAN = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("map", T.BinaryType()), T.StructField("shingle", T.LongType()), T.StructField("times", T.LongType())])


def _scan(width: int):
    """Size, signature and bitmap of each document's set; shingles that several
    different sets of one pack hold, with how many."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("map", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])

    def heavy(held):
        if held:
            shingles, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 3
            k = int(often.sum())
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(shingles[often].view(np.int64)), pa.array(times[often], pa.int64())], schema=schema)

    def run(batches):
        worker_forgets()
        seen: set[bytes] = set()
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0)
            for a, edges, shingles in shingle_sets(batch.column(1), width):
                k = len(edges) - 1
                sets = [shingles[edges[j] : edges[j + 1]] for j in range(k)]
                sigs = [signature(s) if len(s) else None for s in sets]
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, k), pa.array(np.diff(edges)), pa.array(sigs, pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), none, none], schema=schema)
                for sig, own in zip(sigs, sets):
                    if sig is not None and sig not in seen:
                        seen.add(sig)
                        held.append(own)
                        size += len(own)
                if size > 1 << 20:
                    yield from heavy(held)
                    held, size = [], 0
        yield from heavy(held)

    return run


_PACK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sigs", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("shingles", T.BinaryType()), T.StructField("owner", T.BinaryType()), T.StructField("place", T.BinaryType())])


def _index(width: int, percent: int, buckets: int, heavy):
    """Index postings of each distinct set, packed by bucket of shingles."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("sigs", "sizes", "shingles", "owner", "place"))])

    def flush(sigs, sizes, shingles):
        if not sigs:
            return
        sizes = np.array(sizes, np.int64)
        value, owner = np.concatenate(shingles), np.repeat(np.arange(len(sigs)), sizes)
        keys, ranks = heavy.value
        common = np.zeros(len(value), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            common = np.where(keys[at] == value, ranks[at], 0)
        order = np.lexsort((value, common, owner))
        value = value[order]
        place = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        needed = sizes - (percent * sizes + 99) // 100 + 1
        keep = place < needed[owner]
        value, owner, place = value[keep], owner[keep], place[keep]
        bucket = ((value >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        value, owner, place, bucket = value[by], owner[by], place[by], bucket[by]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        table = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 16)
        rows = []
        for k in range(buckets):
            a, b = edge[k], edge[k + 1]
            if a < b:
                own, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((k, table[own].tobytes(), sizes[own].tobytes(), value[a:b].tobytes(), local.astype(np.int32).tobytes(), place[a:b].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        seen: set[bytes] = set()
        sigs, sizes, shingles, size = [], [], [], 0
        for batch in batches:
            for _, edges, values in shingle_sets(batch.column(1), width):
                for j in range(len(edges) - 1):
                    own = values[edges[j] : edges[j + 1]]
                    if len(own) and (sig := signature(own)) not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        sizes.append(len(own))
                        shingles.append(own)
                        size += len(own)
                if size > PACK_BYTES // 8:
                    yield from flush(sigs, sizes, shingles)
                    sigs, sizes, shingles, size = [], [], [], 0
        yield from flush(sigs, sizes, shingles)

    return run


_LIST = T.StructType([T.StructField("list", T.BinaryType()), T.StructField("sig", T.BinaryType())])


def _lists(percent: int):
    """Lists of the buckets that a task gets, as (list, member) rows: blocks of
    two members or more, those with the same smallest member as one."""
    schema = pa.schema([("list", pa.binary()), ("sig", pa.binary())])

    def walk(packs):
        sigs = np.concatenate([np.frombuffer(p[0], "V16") for p in packs])
        sizes = np.concatenate([np.frombuffer(p[1], np.int64) for p in packs])
        shift = np.cumsum([0, *(len(p[1]) // 8 for p in packs)])
        value = np.concatenate([np.frombuffer(p[2], np.uint64) for p in packs])
        owner = np.concatenate([np.frombuffer(p[3], np.int32).astype(np.int64) + s for p, s in zip(packs, shift)])
        place = np.concatenate([np.frombuffer(p[4], np.int32).astype(np.int64) for p in packs])
        names, code = np.unique(sigs, return_inverse=True)  # copies from other tasks are one set
        size_of = np.zeros(len(names), np.int64)
        size_of[code] = sizes
        owner = code[owner]
        order = np.lexsort((owner, size_of[owner], value))
        value, owner, place = value[order], owner[order], place[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner, place = value[new], owner[new], place[new]
        n = size_of[owner]
        # A block ends with its shingle or where the next size is out of reach.
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (100 * n[:-1] < percent * n[1:])
        block = np.cumsum(new) - 1
        # Position: with k shingles passed, at most n - k can be shared; the partner in
        # the block that asks for the least is its smallest, or itself if that is larger.
        least = n[np.flatnonzero(new)][block]
        alone = (n - place) * (100 + percent) < percent * (n + np.maximum(least, (percent * n + 99) // 100))
        keep = ~alone
        owner, block = owner[keep], block[keep]
        counts = np.bincount(block)
        keep = counts[block] > 1
        owner, block = owner[keep], block[keep]
        if not len(owner):
            return
        # Lists with one smallest member are walked as one: whatever meets in one of them
        # meets there too, and the lists of a group of near copies have most members in common.
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        key = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.append(start, len(owner))))
        both = np.unique(key << 32 | owner)
        for a in range(0, len(both), 50_000):
            keys, own = both[a : a + 50_000] >> 32, both[a : a + 50_000] & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names[k]], pa.binary()) for k in (keys, own)], schema=schema)

    def run(batches):
        current, packs = None, []
        for batch in batches:
            for bucket, *pack in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if bucket != current and packs:
                    yield from walk(packs)
                    packs = []
                current = bucket
                packs.append(pack)
        if packs:
            yield from walk(packs)

    return run


_MEMBER = T.StructType([T.StructField("list", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("chunks", T.IntegerType())])


def _partnered(percent: int):
    """The members of each list, of (list, n, sig, id, map) rows in that order, that may have a partner there."""
    schema = pa.schema([("list", pa.binary()), ("sig", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("chunks", pa.int32())])

    def run(batches):
        out, current, held = [], None, []

        def flush():
            if len(held) > 1:
                kept = np.flatnonzero(partnered(np.array([r[0] for r in held], np.int64), [r[3] for r in held], percent))
                out.extend((current, held[k][1], held[k][2], held[k][0], 1) for k in kept.tolist())

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if key != current:
                    flush()
                    current, held = key, []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        flush()
        if out:
            yield batch_of(out)

    return run


_SET = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def _sets(width: int):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _, edges, values in shingle_sets(batch.column(0), width):
                sigs, sets = [], []
                for j in range(len(edges) - 1):
                    own = values[edges[j] : edges[j + 1]]
                    if len(own) and (sig := signature(own)) not in seen:
                        seen.add(sig)
                        sigs.append(sig)
                        sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["sig", "shingles"])

    return run


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _walks(percent: int):
    """Forests of the walks that a task gets, from (walk, id, group, wanted, shingles) rows in order of walk."""

    def walk(ids, groups, wanted, shingles):
        if len(ids) > 1:
            edges = list(Walk([np.frombuffer(s, np.uint64) for s in shingles], percent, np.array(groups), np.array(wanted)).edges())
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([ids[e[side]] for e in edges], pa.int64()) for side in (0, 1)], names=["a", "b"])

    def run(batches):
        current, held = None, ([], [], [], [])
        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if key != current:
                    yield from walk(*held)
                    current, held = key, ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        yield from walk(*held)

    return run


def _walked(rows: DataFrame, key: list[str], sets: DataFrame, percent: int, n_parts: int, name: str) -> DataFrame:
    """Edges from the walks that ``key`` tells apart; rows have sig, id, group and wanted as well."""
    keyed = rows.select(F.xxhash64(*key).alias("deal"), F.struct(*key).alias("walk"), "sig", "id", "group", "wanted")
    whole = keyed.join(sets.hint("merge"), "sig").repartition(n_parts, "deal").sortWithinPartitions("walk")
    plain = F.concat_ws("/", *(F.hex(f"walk.{k}") for k in key)).alias("walk")
    return materialize(whole.select(plain, "id", "group", "wanted", "shingles").mapInArrow(frugal(_walks(percent)), _EDGE), name)


def jaccard_components(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): components of the documents whose shingle
    sets satisfy 100 |A and B| >= percent |A or B|."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    scanned = materialize(texts.mapInArrow(frugal(_scan(width)), _SCAN), "jaccard-scan")
    rows = scanned.where("n is not null").select("id", "n", "sig", "map")
    counted = scanned.where("n is null").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "shingle").limit(HEAVY).collect()  # at most HEAVY rows
    keys = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    ranks = np.arange(len(top), 0, -1)
    by = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[by], ranks[by]))

    # A class is named by its least id; rows of one id hold several classes together.
    classes = materialize(rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("map").alias("map")), "jaccard-classes")
    packs = texts.mapInArrow(frugal(_index(width, percent, 4 * n_parts, heavy)), _PACK)
    lists = packs.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists(percent), _LIST)
    first = materialize(lists.distinct().join(classes, "sig").select("list", "sig", "n"), "jaccard-members")
    # Once more, now that lists are long: those with one leader are walked as one.
    leads = first.groupBy("list").agg(F.min(F.struct("n", "sig")).alias("lead"))
    led = first.join(leads.hint("merge"), "list").select(F.col("lead.sig").alias("list"), "sig", "n").dropDuplicates(["list", "sig"])
    second = materialize(led, "jaccard-lists")
    whole = second.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("chunks"))
    large = materialize(whole.where("chunks > 1"), "jaccard-large")  # few: each has MEMBERS sets or SHINGLES shingles
    # In other lists, only members that the bitmaps leave a partner take their sets along.
    mapped = second.join(large, "list", "left_anti").join(classes.select("sig", "id", "map").hint("merge"), "sig").select("list", "n", "sig", "id", "map")
    small = mapped.repartition(n_parts, "list").sortWithinPartitions("list", "n", "sig").mapInArrow(_partnered(percent), _MEMBER)
    split = second.join(large, "list").join(classes.select("sig", "id"), "sig").select("list", "sig", "id", "n", "chunks")
    members = materialize(small.unionByName(split), "jaccard-partnered")

    # The sets that some list asks for.
    needed = members.select("id").distinct()
    found = texts.join(needed.hint("merge"), "id", "left_semi").select("text").mapInArrow(frugal(_sets(width)), _SET)
    sets = materialize(found.join(members.select("sig").distinct().hint("merge"), "sig", "left_semi").dropDuplicates(["sig"]), "jaccard-sets")
    chunked = members.withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    alone = chunked.withColumns({"group": F.xxhash64("sig"), "wanted": F.lit(True)})
    edges = _walked(alone, ["list", "chunk"], sets, percent, n_parts, "jaccard-edges")
    same = materialize(_one_id(rows, classes), "jaccard-ids")
    components = connected_components(edges.unionByName(same))
    more = None
    if large.limit(1).count():
        components = materialize(components, "jaccard-components")
        more = _walked(_open(chunked.where("chunks > 1"), components), ["list", "block", "chunk"], sets, percent, n_parts, "jaccard-more")
        components = connected_components(edges.unionByName(same).unionByName(more))
    out = materialize(_label(rows, classes, components, id_col), "jaccard-result")
    discard(spark, scanned, classes, first, second, members, sets, large, edges, same, *([more] if more is not None else []))
    return out


def _one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between classes that rows of one id belong to."""
    several = rows.where("sig is not null and id is not null").groupBy("id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi")
    named = rows.join(several.select("id"), "id", "left_semi").join(classes.select("sig", F.col("id").alias("a")), "sig")
    return named.select("a", F.col("id").alias("b"))


def _open(chunked: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of the walks that compare what split lists leave in several components: each member outside the largest
    component of its list with all of the list, in blocks like the chunks."""
    named = chunked.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    sizes = named.groupBy("list", "group").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    most = sizes.groupBy("list").agg(F.max(F.struct("size", "group")).alias("top"), F.sum("size").alias("all"), F.sum("shingles").alias("whole"), F.max_by("shingles", F.struct("size", "group")).alias("own"))
    most = most.where("all > top.size").select("list", F.col("top.group").alias("top"), F.greatest(F.ceil((F.col("all") - F.col("top.size")) / MEMBERS), F.ceil((F.col("whole") - F.col("own")) / SHINGLES)).cast("int").alias("blocks"))
    met = named.join(most, "list").withColumn("outside", F.col("group") != F.col("top"))
    outside, own = met.where("outside"), F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    asks = outside.select("list", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sig", "id", "group", F.lit(True).alias("wanted"))
    answers = met.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "sig", "id", "group", F.lit(False).alias("wanted"))
    # A member of a block is not needed once more as an answer to itself.
    again = outside.select("list", own.alias("block"), "chunk", "sig")
    return asks.unionByName(answers.join(again, ["list", "block", "chunk", "sig"], "left_anti"))


def _label(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    named = classes.select("sig", "id").join(found, F.col("id") == F.col("node"), "left").select("sig", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
