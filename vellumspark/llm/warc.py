"""WARC archives of pages, with a two-level capture index for reading single captures back.

Writing: each task packs its pages into archives of the shared folder, one gzip member a record.  Of equal payloads of at
least ``REVISIT_BYTES`` bytes the page with the largest id is a response and the others are revisits of it.

Index: captures sorted by key (the host's labels reversed, then the path, so that captures of one site lie together) go
into compressed blocks; a sparse directory holds the first key of each block.  A lookup searches the directory by
bisection, reads the range of a block and searches in it the same way; its captures are then read by their ranges
of the archives, neighbours in one go.  The directory has at most ``DIRECTORY`` blocks and one more a partition, each
with at most ``KEY_CHARS`` characters of its first key, so its size is bounded: blocks grow with the number of captures.

A task that fails leaves files that nothing names: an archive or a block counts only once its task returns the
places of its records, so lost executors cost no more than their tasks.

Defined cases: null html is an empty payload; a null URL has no target field and the empty key; blanks and control
characters of a URL are percent-encoded in the record; a page without an id is a response unless an equal payload has
an id; repeated rows are records of their own, and those that equal the response in id and payload are
responses too; a long page is one record; keys that begin alike or repeat over many blocks are searched in all of these;
an empty table gives archives and an index without captures; further columns are not stored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, frugal, free_name, materialize, parts, segments, text_bytes

REVISIT_BYTES = 1000
#: An archive ends at so many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 50_000
DIRECTORY, BLOCK_LINES, KEY_CHARS = 1 << 16, 512, 512
#: Captures are read in stretches of an archive of so many bytes.
STRETCH_BYTES = 2 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_UNSAFE = re.compile("[\x00-\x20\x7f]")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)")


def target(url: str | None) -> str | None:
    """A URL as its record has it."""
    return None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """``com,example,blog:8080)/path?query`` of a URL; scheme, user and fragment don't count."""
    url = target(url) or ""
    found = _URL.match(url)
    if not found:
        return url
    host, port, rest = found.groups()
    host = ",".join(reversed(host.lower().split(".")))
    return f"{host}{':' + port if port not in (None, '', '80', '443') else ''}){rest or '/'}"


# --------------------------------------------------------------------------
# Records


def record_id(page_id: int | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:'.encode() + sha1).digest()[:16], version=5)}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One record; a revisit, without the payload, if ``refers_to`` is given."""
    sha1 = hashlib.sha1(payload).digest()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", target(url))] * (url is not None)
    fields += [("WARC-Page-ID", page_id)] * (page_id is not None)
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode())]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Page-ID", refers_to)]
        fields += [("WARC-Refers-To-Target-URI", target(refers_url))] * (refers_url is not None)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(body))]
    return b"".join([b"WARC/1.1\r\n", *(f"{name}: {value}\r\n".encode() for name, value in fields), b"\r\n", body, b"\r\n\r\n"])


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def decode_record(data: bytes) -> dict:
    """What a record says; its lengths and a response's digest are checked."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = _fields(head)
    body = rest[: int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    n, digest = int(_fields(http)["Content-Length"]), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    whole = fields["WARC-Type"] == "response"
    if rest[len(body) :] != b"\r\n\r\n" or (len(payload) != n or hashlib.sha1(payload).digest() != digest if whole else payload):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("WARC-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": n,
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload.decode() if whole else None,
    }


# --------------------------------------------------------------------------
# Files of the shared folder


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme by which the session finds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def _open(folder: str):
    from pyarrow.fs import FileSystem

    files, base = FileSystem.from_uri(folder)
    return files, base.rstrip("/")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_ENTRY = "key string, page_id long, file string, offset long, length long"
_ENTRY_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _write_archives(folder: str, date: str):
    def run(batches):
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        out, entries, at, name = None, [], 0, ""
        try:
            for batch in batches:
                _, offsets = text_bytes(batch.column(2))
                for low, high in segments(offsets):
                    for page_id, url, html, refers_to, refers_url in zip(*(c.slice(low, high - low).to_pylist() for c in batch.columns)):
                        if out is None:
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{base}/{name}", compression=None)
                            info = b"format: WARC File Format 1.1\r\n"
                            at += out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                        member = _member(encode_record(page_id, url, (html or "").encode(), refers_to, refers_url, date))
                        out.write(member)
                        entries.append((url_key(url), page_id, name, at, len(member)))
                        at += len(member)
                        if at >= ARCHIVE_BYTES or len(entries) >= ARCHIVE_RECORDS:
                            out.close()
                            yield _table(entries, _ENTRY_ARROW)
                            out, entries = None, []
            if out is not None:
                out.close()
                yield _table(entries, _ENTRY_ARROW)
                out = None
        finally:
            if out is not None:
                out.close()

    return frugal(run)


def with_responses(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): the pages, and of revisits the response.

    Digests that make up more than their share of the repeated rows are few, so they are broadcast; the rows
    that have one of those, or a short payload, are dealt at random in the join of the others.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.col("html").cast("binary")))))
    told = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max(told).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = materialize(groups, "warc-repeats")
    share = (groups.agg(F.sum("n")).first()[0] or 0) / (4 * parts(spark))
    hot = groups.where(F.col("n") > share).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")  # at most 4 rows a partition
    alone = F.sha1(F.monotonically_increasing_id().cast("string")).cast("binary")
    rows = rows.withColumn("dealt", F.when(F.col("digest").isNull() | F.col("hot").isNotNull(), alone).otherwise(F.col("digest")))
    rest = groups.where(F.col("n") <= share).select(F.col("digest").alias("dealt"), F.col("first").alias("rest_first"))
    rows = rows.join(rest, "dealt", "left").withColumn("first", F.coalesce("hot_first", "rest_first"))
    other = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    found = rows.select("page_id", "url", "html", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("refers_url"))
    found._vellum_groups = groups
    return found


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes the pages to archives under ``folder``; (key, page_id, file, offset, length) of each record, written too."""
    found = with_responses(pages)
    entries = materialize(found.mapInArrow(_write_archives(qualified(pages.sparkSession, folder), date), _ENTRY), "warc-entries")
    discard(pages.sparkSession, found._vellum_groups)
    return entries


# --------------------------------------------------------------------------
# Index

_BLOCK = "part int, seq int, first string, file string, offset long, length long"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _write_blocks(folder: str, lines: int):
    def run(batches):
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        part, name, rows, at, held = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.cdx.gz", [], 0, []
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:

            def flush():
                nonlocal at
                block = _member("".join("{}\t{}\t{}\t{}\t{}\n".format(*e) for e in held).encode())
                out.write(block)
                rows.append((part, len(rows), held[0][0][:KEY_CHARS], name, at, len(block)))
                at += len(block)
                held.clear()

            for batch in batches:
                for key, page_id, *place in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append((key, "" if page_id is None else page_id, *place))
                    if len(held) >= lines:
                        flush()
            if held:
                flush()
        yield _table(rows, _BLOCK_ARROW)

    return run


@dataclass
class CaptureIndex:
    """The directory of a capture index, and where its blocks and archives lie."""

    folder: str
    directory: DataFrame

    def _blocks(self) -> list:
        """The directory in key order; bounded as the module says."""
        return self.directory.orderBy("part", "seq").collect()

    def lookup(self, urls: DataFrame) -> DataFrame:
        """(key, page_id, file, offset, length) of all captures of each URL of the first column of ``urls``."""
        spark = urls.sparkSession
        blocks = self._blocks()
        firsts = [b.first for b in blocks]
        keys = urls.select(F.col(urls.columns[0]).cast("string").alias("url")).mapInArrow(_keys, "key string").distinct()
        pairs = keys.mapInArrow(_search_directory(spark.sparkContext.broadcast(firsts)), "block int, key string")
        places = spark.sparkContext.broadcast([(b.file, b.offset, b.length) for b in blocks])
        dealt = pairs.repartition(parts(spark), "block").sortWithinPartitions("block", "key")
        return dealt.mapInArrow(_search_blocks(qualified(spark, self.folder), places), _ENTRY)

    def read(self, captures: DataFrame) -> DataFrame:
        """The records at the places that :meth:`lookup` gives, read back from the archives."""
        spark = captures.sparkSession
        stretch = free_name("stretch", captures.columns)
        near = captures.select("file", "offset", "length", F.expr(f"offset div {STRETCH_BYTES}").alias(stretch))
        dealt = near.repartition(parts(spark), "file", stretch).sortWithinPartitions("file", "offset")
        return dealt.select("file", "offset", "length").mapInArrow(_read_records(qualified(spark, self.folder)), _RECORD)

    def discard(self, spark: SparkSession) -> None:
        """Deletes archives and index."""
        discard(spark, self.directory)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def build_index(entries: DataFrame, folder: str) -> CaptureIndex:
    """Sorts the places of records into compressed blocks beside the archives of ``folder``."""
    spark = entries.sparkSession
    lines = max(BLOCK_LINES, -(-entries.count() // DIRECTORY))
    order = ["key", "page_id", "file", "offset"]
    ordered = entries.select(*order[:2], *order[2:], "length").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    return CaptureIndex(folder, materialize(ordered.mapInArrow(_write_blocks(qualified(spark, folder), lines), _BLOCK), "warc-directory"))


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], names=["key"])


def candidates(firsts: list[str], key: str) -> range:
    """The blocks that may hold a key: from the last that begins below it to the last that begins at or below it."""
    short = key[:KEY_CHARS]
    return range(max(0, bisect_left(firsts, short) - 1), bisect_right(firsts, short))


def _search_directory(firsts):
    def run(batches):
        for batch in batches:
            pairs = [(block, key) for key in batch.column(0).to_pylist() for block in candidates(firsts.value, key)]
            yield _table(pairs, pa.schema([("block", pa.int32()), ("key", pa.string())]))

    return run


def _search_blocks(folder: str, places):
    def run(batches):
        files, base = _open(folder)
        current, lines, keys = None, [], []
        for batch in batches:
            found = []
            for block, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != current:
                    name, offset, length = places.value[block]
                    with files.open_input_file(f"{base}/{name}") as file:
                        lines = zlib.decompress(file.read_at(length, offset), 31).decode().split("\n")[:-1]
                    current, keys = block, [line.split("\t", 1)[0] for line in lines]
                for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    _, page_id, name, offset, length = line.split("\t")
                    found.append((key, int(page_id) if page_id else None, name, int(offset), int(length)))
            yield _table(found, _ENTRY_ARROW)

    return run


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def _stretches(rows):
    """Runs of places that lie in one archive near each other."""
    run: list[tuple] = []
    for name, offset, length in rows:
        if run and (run[0][0] != name or offset + length - run[0][1] > STRETCH_BYTES):
            yield run
            run = []
        run.append((name, offset, length))
    if run:
        yield run


def _read_records(folder: str):
    def run(batches):
        files, base = _open(folder)
        for batch in batches:
            for places in _stretches(zip(*(c.to_pylist() for c in batch.columns))):
                name, start = places[0][:2]
                with files.open_input_file(f"{base}/{name}") as file:
                    data = file.read_at(places[-1][1] + places[-1][2] - start, start)
                rows = [decode_record(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in places]
                yield _table([tuple(r[f] for f in _RECORD_ARROW.names) for r in rows], _RECORD_ARROW)

    return frugal(run)
