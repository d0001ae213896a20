"""Fill-in-middle: a text becomes prefix, suffix and middle, cut between units.

The tokenizers library's ``Split`` pre-tokenizer, with a regular expression whose matches are isolated pieces, gives
the code-point offsets of the units; nothing is trained.  The number of offsets gives n, and the two offsets that a
digest of the row's id ranks give the slices.  A row becomes plain (unchanged), ``psm`` (prefix, suffix, middle) or
``spm`` (suffix, prefix, middle) by further parts of the same digest, so that every run and every
partitioning makes the same choice.

Defined cases: a null text is empty; an empty text and one that holds a mark stay plain (so the marks of any other
output are the three that were put in, and :func:`restored` is exact); a null id is digested as the empty string; a
long text is one piece of work whose offsets are held in memory; rows of one id are cut alike if their texts have as
many units; repeated rows stay; ties of the two ranks give an empty middle; an empty table gives an empty result;
further columns are carried along, whatever their names, if ``keep`` lists them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, segments, text_bytes

#: A line with its end, or the last line without one; the marks before prefix, suffix and middle.
LINES = "[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated")


def unit_edges(text: str, pattern: str = LINES) -> list[int]:
    """Code-point offsets between the units of a text, both ends included: n + 1 of them."""
    return [0, *(end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text))]


def choices(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers that the row's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform_text(doc_id: int | None, text: str, seed: int, fim_percent: int, spm_percent: int, marks: tuple[str, str, str] = MARKS, pattern: str = LINES) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix and of the middle, output)."""
    h1, h2, h3, h4 = choices(seed, doc_id)
    edges = unit_edges(text, pattern)
    n = len(edges) - 1
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in marks):
        return n, "plain", None, None, text
    first, second = sorted((edges[h1 % (n + 1)], edges[h2 % (n + 1)]))
    prefix, middle, suffix = (mark + part for mark, part in zip((marks[0], marks[2], marks[1]), (text[:first], text[first:second], text[second:])))
    spm = h4 % 100 < spm_percent
    return n, "spm" if spm else "psm", first, second - first, suffix + prefix + middle if spm else prefix + suffix + middle


_ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _transform_batches(settings):
    def run(batches):
        for batch in batches:
            ids, texts, kept = batch.column(0), batch.column(1), batch.columns[2:]
            _, offsets = text_bytes(texts)
            for low, high in segments(offsets):
                rows = [transform_text(i, t or "", *settings) for i, t in zip(ids.slice(low, high - low).to_pylist(), texts.slice(low, high - low).to_pylist())]
                added = [pa.array(values, kind) for values, kind in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *added, *(c.slice(low, high - low) for c in kept)], names=["doc_id", *_ADDED.names, *(f"kept{k}" for k in range(len(kept)))])

    return frugal(run)


def fill_middle(
    docs: DataFrame,
    *,
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS,
    pattern: str = LINES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row, then the ``keep`` columns as a struct ``kept``.

    ``fim_percent`` of the rows are transformed, ``spm_percent`` of those suffix first.  No row is shuffled.
    """
    if len(set(marks)) < 3 or not all(marks) or any(a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in marks for b in marks):
        raise ValueError("the three marks must differ, and none may lie in another or begin as one ends")
    if not keep:
        source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    else:
        source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_ADDED.fields, *source.schema.fields[2:]])
    made = source.mapInArrow(_transform_batches((seed, fim_percent, spm_percent, tuple(marks), pattern)), schema)
    if not keep:
        return made
    return made.select("doc_id", *_ADDED.names, F.struct(*(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep))).alias("kept"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, by its form alone."""
    escaped = "|".join("\\Q" + mark + "\\E" for mark in marks)
    parts = F.split(output, escaped)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest_outputs(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Outputs and the texts rebuilt from them, as digests."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"),
    )
