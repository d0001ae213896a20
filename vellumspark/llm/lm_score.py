"""Language-model scores from a causal self-attention model over subword ids.

The model's text is the sequence of tokens that the base score has as well: words in lower case (A-Z), each after a
space, and one end.  Words are cut into subword ids of a public vocabulary; the ids of a text fall into context windows
that overlap, and each id is scored once, by batched attention under a causal mask (see ``attention``).

Counts of ids in all training texts give the classes and first biases.  The block, its embeddings and its output vectors
are trained by Adam on every window of every training text, on all partitions at once: texts are dealt by hash to rounds
of growing size, each text to one, and after a round the partitions' weights are averaged by the ids they have seen, by
groups before the driver sums.  Embeddings and output vectors grow with the ids the corpus has, up to the vocabulary.

The base score is that of add-0.1 unigrams of words (see ``unigram``).

Defined cases: null text is empty and scores its end alone; rows with a null id train; without training rows all counts
are 0, and the model is uniform but for its first weights; very long texts go through batch by batch; ids of equal counts
are ordered by number; repeated rows give repeated results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .attention import Adam, Block, Stream, Vocabulary, Weights, cut_blocks, first_weights
from .common import discard, frugal, held_out, materialize, reuses_memory, worker_forgets, worker_keeps
from .token_counts import encoding, tokenizer_files
from .unigram import SMOOTHING, unigram_sums

VOCABULARY, END = 50_257, 50_256
#: Blocks of one training step and of one scoring pass.
BATCH, PASS = 512, 512
#: Of every 16 hash values of texts, those that each round trains on, and its rate.
ROUNDS = (((0,), 0.05), ((1, 2, 3), 0.05), ((4, 5, 6, 7), 0.03), (tuple(range(8, 16)), 0.015))
#: Ids that a training task has at least: fewer would leave its weights near where they began.
TASK_IDS = 6_000_000
#: Words whose ids one Python worker remembers, and the longest of them in bytes.
MEMO_WORDS, MEMO_LENGTH = 500_000, 48


# --------------------------------------------------------------------------
# Subword ids


class _WordIds(dict):
    """Ids of each word after a space, made on first sight; forgets all when full."""

    def __init__(self, ranks_path: str):
        super().__init__()
        self.encode = encoding(ranks_path).encode_ordinary

    def __missing__(self, word: bytes) -> bytes:
        value = array("H", self.encode(" " + word.decode())).tobytes()
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def _memo(ranks_path: str) -> _WordIds:
    return worker_keeps(("words", ranks_path), lambda: _WordIds(ranks_path))


def subword_ids(text: str, ranks_path: str) -> bytes:
    """16-bit ids of a text's words.  Both methods of ``bytes`` are about ASCII alone."""
    return b"".join(map(_memo(ranks_path).__getitem__, text.encode().lower().split()))


_IDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("train", T.BooleanType()), T.StructField("ids", T.BinaryType())])


def _encode(ranks_path: str):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                piece = batch.slice(a, 500)
                ids = pa.array([subword_ids(t, ranks_path) for t in piece.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in range(3)), ids], names=_IDS.fieldNames())

    return run


_COUNT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])


def _counts(batches):
    """Counts of the ids of a partition, ends included."""
    worker_forgets()  # it encodes no more
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            total += np.bincount(np.frombuffer(ids.as_buffer(), np.uint16), minlength=VOCABULARY)
            total[END] += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["id", "n"])


def id_counts(encoded: DataFrame) -> np.ndarray:
    out = np.zeros(VOCABULARY, np.int64)
    for r in encoded.where("train").select("ids").mapInArrow(_counts, _COUNT).groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most VOCABULARY rows
        out[r["id"]] = r["n"]
    return out


# --------------------------------------------------------------------------
# Distributed training and scoring

_STATE = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("state", T.BinaryType())])
_STATE_ARROW = pa.schema([("slot", pa.int32()), ("weight", pa.float64()), ("state", pa.binary())])


def _state_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, _STATE_ARROW)], schema=_STATE_ARROW)


def pack_weights(w: Weights) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def unpack_weights(state, vocabulary: Vocabulary) -> Weights:
    flat, at, w = np.array(np.frombuffer(state, np.float32)), 0, {}
    shapes = {k: v.shape for k, v in first_weights(vocabulary).items()}
    for k in sorted(shapes):
        size = int(np.prod(shapes[k]))
        w[k], at = flat[at : at + size].reshape(shapes[k]), at + size
    return w


def blocks_of(ids, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, first = cut_blocks(np.frombuffer(ids, np.uint16), END)
    return vocabulary.place[x], y, first


def _train(shared, rate: float, slots: int):
    """Trains on all texts of a partition; yields its weights and how many ids they have learned from."""

    def run(batches):
        reuses_memory()
        state, vocabulary = shared.value
        adam, stream, seen, slot = Adam(unpack_weights(state, vocabulary), rate), Stream(BATCH), 0, 0

        def learn(batch):
            _, x, y, first, lead = batch
            n = int((y >= 0).sum())
            if n:
                adam.step(Block(adam.w, vocabulary, x, first, lead).logs(y, gradient=True)[1])
            return n

        for batch in batches:
            for h, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                slot ^= h & 0x7FFF
                for full in stream.add(0, *blocks_of(ids.as_buffer(), vocabulary)):
                    seen += learn(full)
        for last in stream.rest():
            seen += learn(last)
        if seen:
            yield _state_batch([(slot % slots, float(seen), pack_weights(adam.w))])

    return run


def _average(batches):
    """Weighted means of the states of each slot."""
    sums: dict[int, list] = {}
    for batch in batches:
        for slot, weight, state in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = sums.setdefault(slot, [0.0, 0.0])
            own[0] += weight
            own[1] = own[1] + weight * np.frombuffer(state, np.float32).astype(np.float64)
    yield _state_batch([(s, w, (x / w).astype(np.float32).tobytes()) for s, (w, x) in sorted(sums.items())])


def train_model(encoded: DataFrame) -> tuple[bytes, Vocabulary]:
    """Packed weights and the vocabulary, from (h, train, ids) rows."""
    spark = encoded.sparkSession
    counts = id_counts(encoded)
    vocabulary = Vocabulary(counts)
    tasks = min(encoded.rdd.getNumPartitions(), 1 + int(counts.sum()) // TASK_IDS)
    state = pack_weights(first_weights(vocabulary))
    slots = max(1, int(tasks**0.5))
    for part, rate in ROUNDS:
        shared = spark.sparkContext.broadcast((state, vocabulary))  # at most 14 MB: bounded by the vocabulary
        texts = encoded.where(F.col("train") & F.pmod("h", F.lit(16)).isin(*part)).select("h", "ids").coalesce(tasks)
        states = texts.mapInArrow(frugal(_train(shared, rate, slots)), _STATE)
        rows = states.repartition(slots, "slot").mapInArrow(_average, _STATE).collect()  # the root of the number of tasks
        if rows:
            total = sum(r["weight"] for r in rows)
            state = sum(np.frombuffer(r["state"], np.float32).astype(np.float64) * (r["weight"] / total) for r in sorted(rows, key=lambda r: r["slot"])).astype(np.float32).tobytes()
    return state, vocabulary


def score_texts(w: Weights, vocabulary: Vocabulary, texts) -> np.ndarray:
    """log10 chances of texts, given as their ids."""
    out, stream = np.zeros(len(texts)), Stream(PASS)

    def take(batch):
        owner, x, y, first, lead = batch
        logs = Block(w, vocabulary, x, first, lead).logs(y).reshape(len(x), -1).sum(1)
        np.add.at(out, owner, logs)

    for k, ids in enumerate(texts):
        for full in stream.add(k, *blocks_of(ids, vocabulary)):
            take(full)
    for last in stream.rest():
        take(last)
    return out / np.log(10)


_SCORED = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("score", T.DoubleType())])


def _score(shared):
    def run(batches):
        reuses_memory()
        state, vocabulary = shared.value
        w = unpack_weights(state, vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                scores = score_texts(w, vocabulary, [ids.as_buffer() for ids in piece.column(2)])
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(scores)], names=_SCORED.fieldNames())

    return run


def score_documents(docs: DataFrame, *, folds: int = 10, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = F.coalesce(held_out(id_col, folds, 0), F.lit(False))
    none = F.lit(-(1 << 63))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.xxhash64(text).alias("h"), (~out).alias("train"), text.alias("text"))
    encoded = materialize(texts.mapInArrow(frugal(_encode(tokenizer_files(tokenizer)[1])), _IDS), "subword-ids")
    shared = spark.sparkContext.broadcast(train_model(encoded))  # bounded by the vocabulary
    scored = encoded.select("id", "h", "ids").mapInArrow(frugal(_score(shared)), _SCORED).groupBy("id", "h").agg(F.min("score").alias("score"))
    scored, ends = materialize(scored, "lm-scores"), encoded.where("train").count()
    discard(spark, encoded)
    sums, distinct, words = unigram_sums(texts)
    total, kinds = words + ends, distinct + (ends > 0)
    n = F.col("words") + 1
    base = F.col("logs") + F.lit(float(np.log10(ends + SMOOTHING))) - n * F.lit(float(np.log10(total + SMOOTHING * (kinds + 1))))
    joined = sums.join(scored, ["id", "h"]).select(
        F.nullif("id", none).alias(id_col), n.alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
    return joined.select(id_col, F.coalesce(held_out(id_col, folds, 0), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
