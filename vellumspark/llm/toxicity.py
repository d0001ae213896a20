"""Toxicity by compression distance.

zstandard trains one dictionary on ordinary and one on toxic labelled texts.
Windows of a text are compressed with the ordinary dictionary and with both
together; the bytes that the toxic one saves say how much nearer a window is to
toxic text.  A document's score adds up, over its windows, the log odds of
their savings, and thresholds calibrated on labelled texts that the
dictionaries have not seen make a chance of that sum.

* Windows are words (with their leading space, A-Z lowered).  zstandard stores
  inputs of a dozen bytes as they are, so a window is compressed ``REPEAT``
  times in a row; the repeats cost the same with either dictionary.
* Both dictionaries are the library's, trained on whole texts.  The toxic one
  holds much that is ordinary as well: windows of the fit texts that it shortens
  although they are about as frequent in ordinary texts (``RATE`` of their
  frequency in toxic ones or more) are added to the ordinary dictionary, until
  none is left (at most ``ROUNDS`` times).
* Fitting takes a bounded sample of labelled rows: at most ``FIT_TOXIC`` and
  ``FIT_ORDINARY`` texts, the first by a hash of their ids, as long as they have
  ``FIT_BYTES`` together.  Equal texts count once.  Two thirds train the
  dictionaries, one third calibrates.  Scoring takes every whole text.

Defined cases: null or empty text has the score of no window; fit rows without
one of the classes give score 0 everywhere; fit texts too few or short for the
library's trainer are their dictionary themselves; repeated or conflicting
labels of a document count as toxic if one is; very long texts are scored
window by window; rows of equal id and text have equal scores; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, held_out, worker_keeps

FIT_TOXIC, FIT_ORDINARY, FIT_BYTES = 1500, 6000, 24 << 20
#: Parts of the texts that are trained on apart, bytes of each part's dictionary, and the trainer's segment and match lengths.
PARTS, DICTIONARY, SEGMENT, MATCH = 3, 64_000, 16, 6
REPEAT, RATE, ROUNDS = 4, 0.3, 6
#: Savings of so many bytes and more are one level.
LEVELS = 5
MEMO_WORDS = 250_000
CUT = 0.7

_WINDOW = re.compile(rb" ?[^\x20\x09-\x0d]+")


def _lower(text: str) -> bytes:
    return text.encode().lower()  # bytes.lower touches A-Z only


def _trained(texts: list[bytes]) -> bytes:
    """The library's dictionaries of the parts of the texts, one after the other: what one misses, another has."""
    return b"".join(_of_part(texts[k::PARTS]) for k in range(PARTS))


def _of_part(texts: list[bytes]) -> bytes:
    """The library's dictionary of the texts; where it finds them too few, their own bytes."""
    import zstandard

    pieces = [t[a : a + 2000] for t in texts for a in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, pieces)) // 4)), pieces, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def _compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=21, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    content = content + bytes(16)  # the matcher does not index the last bytes of a dictionary
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    #: Log odds of a window by the bytes that the toxic dictionary saves on it: none, 1, 2 ...
    odds: list[float] = field(default_factory=lambda: [0.0] * LEVELS)
    #: Calibration: a text whose sum of odds reaches ``levels[k]`` is toxic with chance ``chances[k]``.
    levels: list[float] = field(default_factory=lambda: [-1e300])
    chances: list[float] = field(default_factory=lambda: [0.0])

    def scorer(self):
        """A function of a text; remembers the windows that it has met."""
        if not self.toxic:
            return lambda text: 0.0
        saved, levels, chances = Savings(self.ordinary, self.toxic), np.array(self.levels), self.chances
        odds = _Odds(saved, self.odds)

        def score(text: str | None) -> float:
            return float(chances[int(np.searchsorted(levels, odds.of_text(_lower(text or "")), side="right")) - 1])

        return score


class Savings:
    """Bytes that the toxic dictionary saves on a window beside the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary), _compressor(toxic + ordinary)

    def of(self, window: bytes) -> int:
        repeated = window * REPEAT
        value = len(self.plain(repeated)) - len(self.both(repeated))
        return 0 if abs(value) > len(window) else value  # one of the two gave up and stored the window as it is


class _Odds(dict):
    """Log odds of each window, made on first sight; forgets all when full."""

    def __init__(self, saved: Savings, odds: list[float]):
        super().__init__()
        self.saved, self.odds = saved, odds

    def __missing__(self, window: bytes) -> float:
        value = self.odds[min(max(self.saved.of(window), 0), LEVELS - 1)]
        if len(window) <= 48:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[window] = value
        return value

    def of_text(self, text: bytes) -> float:
        return round(sum(map(self.__getitem__, _WINDOW.findall(text))), 9)


def _windows(texts: list[bytes]) -> Counter:
    return Counter(w for t in texts for w in _WINDOW.findall(t))


def fit(rows: list[tuple[str | None, int]]) -> ToxicityModel:
    """Dictionaries and thresholds from (text, label) rows in a fixed order."""
    toxic, ordinary = (list(dict.fromkeys(_lower(text or "") for text, label in rows if bool(label) == kind)) for kind in (True, False))
    if len(toxic) < 3 or len(ordinary) < 3:
        return ToxicityModel()
    train = [[t for k, t in enumerate(own) if k % 3 != 2] for own in (toxic, ordinary)]
    rest = [[t for k, t in enumerate(own) if k % 3 == 2] for own in (toxic, ordinary)]
    marked, plain = map(_trained, train)
    of_toxic, of_ordinary = map(_windows, train)
    share = RATE * sum(of_ordinary.values()) / max(1, sum(of_toxic.values()))
    alike = [w for w, n in of_ordinary.items() if n >= share * of_toxic.get(w, 0)]
    for _ in range(ROUNDS):
        saved = Savings(plain, marked)
        known = [w for w in alike if saved.of(w) > 0]
        if not known:
            break
        plain += b"".join(known)
    model, saved = ToxicityModel(plain, marked), Savings(plain, marked)
    levels = [np.zeros(LEVELS), np.zeros(LEVELS)]
    for of_class, own in zip(levels, rest):
        for window, n in _windows(own).items():
            of_class[min(max(saved.of(window), 0), LEVELS - 1)] += n
    odds = np.log((levels[0] + 0.5) / (levels[0].sum() + LEVELS / 2)) - np.log((levels[1] + 0.5) / (levels[1].sum() + LEVELS / 2))
    model.odds = odds.tolist()
    found = _Odds(saved, model.odds)
    points = sorted((found.of_text(t), label) for label, texts in ((1, rest[0]), (0, rest[1])) for t in texts)
    # Pool adjacent violators: the chance never falls as the odds rise.
    blocks: list[list[float]] = []  # level, toxic, all
    for level, label in points:
        if blocks and blocks[-1][0] == level:
            blocks[-1][1] += label
            blocks[-1][2] += 1
        else:
            blocks.append([level, label, 1])
    pooled: list[list[float]] = []
    for block in blocks:
        pooled.append(block)
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0], pooled[-1][1] + last[1], pooled[-1][2] + last[2]]
    # A threshold lies halfway to what was met below it.
    below = [-1e300, *(max(level for level, _ in points if level < b[0]) for b in pooled[1:])]
    model.levels = [-1e300, *((b[0] + x) / 2 for b, x in zip(pooled[1:], below[1:]))]
    model.chances = [(b[1] + 0.05) / (b[2] + 0.1) for b in pooled]
    return model


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str | None, int]]:
    """The bounded sample of labelled texts, outside fold 1 of 3."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = [known.where("label <> 0").orderBy(*order).limit(FIT_TOXIC), known.where("label = 0").orderBy(*order).limit(FIT_ORDINARY)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most FIT_TOXIC + FIT_ORDINARY rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Of rows that share an id, the least text counts.
    sized = rows.join(ids, "id").groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))).alias("one"))
    part = F.when(F.col("label") != 0, 1).otherwise(0)
    before = F.sum("one.bytes").over(Window.partitionBy(part).orderBy(*order))  # of the picked rows alone
    limit = F.when(F.col("label") != 0, F.lit(FIT_BYTES // 4)).otherwise(F.lit(FIT_BYTES * 3 // 4))
    chosen = F.broadcast(sized.withColumn("before", before).where(F.col("before") <= limit).select("id", "label", F.col("one.hash").alias("hash")))
    sample = rows.join(chosen, "id").where(F.xxhash64("text") == F.col("hash")).select(F.xxhash64("id").alias("h"), "id", "text", "label").dropDuplicates(["id"])
    return [(r["text"], r["label"]) for r in sorted(sample.collect(), key=lambda r: (r["h"], r["id"]))]  # FIT_BYTES at most


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    schema = T.StructType([docs.select(F.col(id_col).alias("id")).schema[0], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries; their size is bounded by the sample's

    def run(batches):
        score = _scorer(shared.value)
        for batch in batches:
            scores = pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out("id", 3, 1), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def _scorer(model: ToxicityModel):
    """The scorer of a model, kept for the worker's next tasks."""
    return worker_keeps(("toxicity", model.toxic, model.ordinary, tuple(model.levels), tuple(model.chances)), model.scorer)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``CUT``, unchanged."""
    at = docs.schema.fieldNames().index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(t) < CUT for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
