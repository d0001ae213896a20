"""Shared plumbing: shared-folder tables, Arrow text access and byte hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels (about 100 bytes of
#: working memory each).  A longer document forms a segment of its own.
SEGMENT_BYTES = 1 << 20

_MASK = (1 << 64) - 1
#: While a table is written: what it shuffled goes with the write, and batches of long texts stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``; where that is unset, a temporary folder is
    made for the session if all runs in this one process (tests), and else it is
    an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = getattr(spark.sparkContext, "_vellum_dir", None)
    if own is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext._vellum_dir = own
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_vellum_path", None)
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(column: str, folds: int, fold: int):
    """Fold of a row by the crc32 of its id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds) == F.lit(fold)


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------
# Arrow strings as flat byte arrays


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(offsets: np.ndarray, limit: int = SEGMENT_BYTES):
    """Ranges of rows whose texts together hold about ``limit`` bytes."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that end a word: space and U+0009 to U+000D.
SPACE_BREAK = np.zeros(256, bool)
SPACE_BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of letters and digits: all ASCII but 0-9 and a-z.
ALNUM_BREAK = np.zeros(256, bool)
ALNUM_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of non-break bytes in each row."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


# --------------------------------------------------------------------------
# 64-bit fingerprints of byte ranges


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values evenly (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Fingerprints are polynomials modulo this prime.
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_BASE = _splitmix(12345) % PRIME
_LENGTH = 0xD6E8FEB86659FD93
#: Bytes over which the sums of one range stay under 64 bits.
_REACH = 1 << 24


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo the prime, for x below it."""
    return ((x & _LOW30) << np.uint64(31)) + (x >> np.uint64(30))


def _times(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """x * (high * 2**31 + low) modulo the prime."""
    x1, x0 = x >> np.uint64(31), x & _LOW31
    cross = x1 * low + x0 * high
    return _reduced(((x1 * high) << np.uint64(1)) + (cross >> np.uint64(30)) + ((cross & _LOW30) << np.uint64(31)) + x0 * low)


_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint32), np.ones(1, np.uint32))] * 2


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the base and of its inverse, as high 30 and low 31 bits."""
    if len(_powers[0][0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, PRIME))):
            table, size = np.ones(1, np.uint64), 1
            while size < n:
                step = pow(base, size, PRIME)
                table = np.concatenate([table, _times(table, np.uint64(step >> 31), np.uint64(step & 0x7FFFFFFF))])
                size *= 2
            _powers[k] = ((table >> np.uint64(31)).astype(np.uint32), (table & _LOW31).astype(np.uint32))
    return _powers


class Fingerprints:
    """Fingerprints of any byte range of one buffer after one linear pass.

    The value of a range is its bytes (plus one) as a polynomial at a fixed base modulo 2**61 - 1, mixed with its
    length.  Equal ranges always agree.  Two different ranges of n bytes agree for at most n of the 2**61 bases;
    the base is a constant, so texts made to collide with it are not defended against.
    """

    def __init__(self, data: np.ndarray):
        (high, low), self.inverse = _power_tables(len(data) + 1)
        value = data.astype(np.uint16) + np.uint16(1)
        self.high, self.low = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
        for sums, power in ((self.high, high), (self.low, low)):
            np.multiply(value, power[: len(data)], out=sums[1:], dtype=np.uint64)
            np.cumsum(sums, out=sums)

    def _between(self, high: np.ndarray, low: np.ndarray, inverse: tuple[np.ndarray, np.ndarray], length) -> np.ndarray:
        raw = _reduced(_shifted(_reduced(high)) + _reduced(low))
        return mix(_times(raw, *inverse) + length)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.high[end] - self.high[start], self.low[end] - self.low[start]
        for k in np.flatnonzero(end - start > _REACH):
            cuts = np.append(np.arange(start[k], end[k], _REACH), end[k])
            high[k], low[k] = (sum(_reduced(np.diff(x[cuts])).tolist()) % PRIME for x in (self.high, self.low))
        return self._between(high, low, (self.inverse[0][start], self.inverse[1][start]), (end - start).astype(np.uint64) * np.uint64(_LENGTH))

    def fixed(self, length: int) -> np.ndarray:
        """Fingerprint of the ``length`` bytes from each position on; ``length`` is under 2**24."""
        n = len(self.high) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        inverse = (self.inverse[0][:n], self.inverse[1][:n])
        return self._between(self.high[length:] - self.high[:n], self.low[length:] - self.low[:n], inverse, np.uint64((length * _LENGTH) & _MASK))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Fingerprints(data).ranges(start, end)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same fingerprints for a list of separate words."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words]).astype(np.int64)
    return word_hashes(data, end - np.array([len(w) for w in words], np.int64), end)


_kept: list = []


def worker_keeps(key, make):
    """What ``make`` gives, kept by the Python worker for its next tasks; it keeps one thing at a time."""
    if not _kept or _kept[0] != key:
        _kept[:] = [key, make()]
    return _kept[1]


def worker_forgets() -> None:
    """Frees what the worker's tasks before have kept."""
    _kept.clear()


def frugal(run):
    """A function of batches that gives memory back to the system at its end: workers stay, and many of them share a machine."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def reuses_memory() -> None:
    """Makes the C library keep up to 64 MB of what is freed for the arrays that come next.  By default it gives arrays of some
    100 KB back at once, and the page faults of new ones cost kernels of small batches as much as their arithmetic.  See ``frugal``."""
    try:
        mallopt = ctypes.CDLL("libc.so.6").mallopt
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, whose largest value this is
    except (OSError, AttributeError):  # another C library
        pass


def free_name(name: str, taken) -> str:
    """``name`` with as many underscores before it as keep it apart from the ``taken`` ones."""
    while name in taken:
        name = f"_{name}"
    return name
