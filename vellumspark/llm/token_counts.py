"""Token counts through a digest cache.

Content is normalised (null becomes the empty text; nothing else is touched,
as any other change could change a count) and digested.  Digests are joined to
stored counts of the same tokenizer version; only distinct misses are encoded,
and their counts are appended to the cache.

Defined cases: null or empty text has 0 tokens; repeated texts are encoded
once; an empty table gives an empty result; extra columns are ignored; special
strings inside texts count as the one special token the library makes of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts

_WS = " \\t\\n\\r\\x0b\\x0c"
#: A stretch that the pre-tokenizer splits alike alone and in its text: a word
#: with at most one leading space, or white space that no word takes over.
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: With other white space a text is encoded in one piece.
OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
#: Chunks remembered by one Python worker, about 200 bytes each; longer ones aren't kept.
MEMO_CHUNKS, MEMO_LENGTH = 400_000, 48


def tokenizer_files(name: str) -> tuple[str, str]:
    """The vocabulary file and the file of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.path(str(Path(name).with_suffix(".tiktoken")))


def version_digest(paths: tuple[str, ...]) -> str:
    digest = hashlib.sha256()
    for path in paths:
        digest.update(hashlib.sha256(Path(path).read_bytes()).digest())
    return digest.hexdigest()


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkMemo(dict):
    """Value of each chunk of text, made on first sight; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        value = self.make(chunk)
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


@lru_cache(maxsize=4)
def _count_memo(ranks_path: str) -> ChunkMemo:
    encode = encoding(ranks_path).encode_ordinary
    return ChunkMemo(lambda chunk: len(encode(chunk)))


def count_text(text: str, ranks_path: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> int:
    for mark in special:
        if mark in text:
            pieces = text.split(mark)
            return len(pieces) - 1 + sum(count_text(p, ranks_path, special) for p in pieces)
    memo = _count_memo(ranks_path)
    if not text.isascii() and OTHER_SPACE.search(text):
        return memo.make(text)
    return sum(map(memo.__getitem__, CHUNK.findall(text)))


_DISTINCT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("text", T.StringType())])
_COUNTED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _first_seen(batches):
    """Each text once a task, so that a group of copies never meets in one task."""
    seen: set[bytes] = set()
    schema = pa.schema([("digest", pa.binary()), ("text", pa.string())])
    for batch in batches:
        digests, texts = [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            digest = hashlib.sha256(text.encode()).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], schema=schema)


def _count_batches(ranks_path: str):
    def run(batches):
        seen: set[bytes] = set()
        schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
        for batch in batches:
            digests, counts = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(count_text(text, ranks_path))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    return run


def cached_counts(spark, cache_path: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; repeats collapse."""
    try:
        stored = spark.read.schema("version string, digest binary, n_tokens bigint").parquet(cache_path)
    except Exception as error:  # no cache yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _COUNTED)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str = "byte_bpe_50k.json",
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    spark = docs.sparkSession
    files = tokenizer_files(tokenizer)
    version = version_digest(files)
    content = F.coalesce(F.col(text_col), F.lit(""))
    known = cached_counts(spark, cache_path, version)
    distinct = docs.select(content.alias("text")).mapInArrow(_first_seen, _DISTINCT)
    misses = distinct.join(known.select("digest"), "digest", "left_anti").repartition(parts(spark), "digest")
    counted = misses.mapInArrow(_count_batches(files[1]), _COUNTED)
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    known = cached_counts(spark, cache_path, version)
    rows = docs.select(
        F.col(id_col).alias(id_col), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    )
    return rows.join(known, "digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
