"""Secret scans by assignment-aware lexing.

A text is lexed for the assignments of source code and configuration files
(``name = "x"``, ``name: x``, ``"name": "x"``, ``NAME=x``, ``a => 'x'``), which
gives name-literal pairs.  Constants are propagated: a bare word on the right
that is itself assigned a literal earlier in the text stands for that literal,
and adjacent literals joined by ``+`` make one.  Each literal is scored by how
sensitive its target name is and how much it looks like a credential; literals
of a score of ``THRESHOLD`` or more are spans of kind ``literal``.  Three fixed
patterns (assign, access, hex) give base spans, which always stay.

Defined cases: null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "literal")

# ASCII only: with re.I alone, U+017F and U+212A would match s and k.
_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Parts of names and how sensitive they make a target.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "access_key": 1.0, "accesskey": 1.0, "private_key": 1.0, "privatekey": 1.0, "credential": 0.9, "auth": 0.6, "bearer": 0.9,
    "signing_key": 0.9, "encryption_key": 0.9, "client_secret": 1.0, "session_key": 0.8, "key": 0.5, "salt": 0.5, "dsn": 0.6,
}
THRESHOLD = 1.0

# Possessive, so that no length needs a limit.
_VALUE = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9+/_.=~$@%!?&*^#-]++))""")
_JOINED = re.compile(r"""[ \t]*+\+[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')""")
_OF_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_SIGN = re.compile(r"=>|:=|(?<![=!<>+*/-])=(?!=)|(?<!:):(?!:)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CREDENTIAL = re.compile(r"[!-~]{8,}")


def sensitivity(name: str) -> float:
    """Highest weight of a part of the name, in snake, kebab or camel case."""
    flat = _CAMEL.sub("_", name).replace("-", "_").replace(".", "_").lower()
    words = set(flat.split("_"))
    best = 0.0
    for part, weight in SENSITIVE.items():
        if weight > best and (part in words or ("_" in part or len(part) > 5) and part in flat):
            best = weight
    return best


def credential_score(literal: str) -> float:
    """0 to 1: length, variety of characters and entropy of a literal."""
    if not _CREDENTIAL.fullmatch(literal):
        return 0.0
    n, counts = len(literal), Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if kinds < 2 or not re.search(r"[0-9]", literal):
        return 0.0
    return min(1.0, 0.25 * min(entropy, 4.0) / 4 * 2 + 0.15 * kinds + 0.2 * min(n, 20) / 20)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, over blanks and at most two closing quotes or brackets; empty if there is none."""
    while at and text[at - 1] in " \t":
        at -= 1
    for _ in range(2):
        if at and text[at - 1] in "\"']":
            at -= 1
    first = at
    while first and text[first - 1] in _OF_NAME:
        first -= 1
    return text[first:at].lstrip("0123456789.-")


def pairs(text: str):
    """(name, literal, start, end) of each assignment; constants propagated.

    A bare word that names an earlier literal yields that literal with the
    place where it is written.
    """
    known: dict[str, tuple[str, int, int]] = {}
    for sign in _SIGN.finditer(text):
        at = sign.start()
        name = name_before(text, at)
        value = _VALUE.match(text, sign.end())
        if not name or not value:
            continue
        group = value.lastindex
        literal, start, end = value[group], value.start(group), value.end(group)
        if group == 4:
            bare = literal.rstrip(".,;)")
            if bare in known:
                literal, start, end = known[bare]
            else:
                literal, end = bare, start + len(bare)
        else:
            more = _JOINED.match(text, value.end())
            while more:
                literal += more[more.lastindex]
                end = more.end(more.lastindex)
                more = _JOINED.match(text, more.end())
        known[name] = (literal, start, end)
        yield name, literal, start, end


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    if ":" not in text and "=" not in text:
        return []
    found = set()
    for name, literal, start, end in pairs(text):
        if len(literal) >= 8 and (weight := sensitivity(name)) and weight + credential_score(literal) >= THRESHOLD + 0.5:
            found.add((start, end, "literal"))
    return list(found)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each ordered by start, then kind as listed."""
    text = text or ""
    base = base_spans(text)
    return _ordered(base), _ordered(base + literal_spans(text))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    spans = scan(text)[1]
    if not spans:
        return text
    pieces, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][:2]
        while k < len(spans) and spans[k][0] <= end:
            end = max(end, spans[k][1])
            k += 1
        pieces += [text[at:start], mark]
        at = end
    return "".join(pieces) + text[at:]


_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base_spans, spans) of every row: arrays of (start, end, kind)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    out = T.StructType([docs.select(F.col(id_col).alias("id")).schema[0], T.StructField("base_spans", _SPAN_TYPE), T.StructField("spans", _SPAN_TYPE)])

    def run(batches):
        for batch in batches:
            both = [scan(text) for text in batch.column(1).to_pylist()]
            rows = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in one[j]] for one in both], span) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["id", "base_spans", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text and its length brought up to date."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    out = docs.mapInArrow(frugal(run), schema)
    if count_col in schema.fieldNames():
        out = out.withColumn(count_col, F.when(F.col(count_col).isNotNull(), F.length(text_col)).cast(schema[count_col].dataType))
    return out


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and strings of the query, from :func:`find_secrets`."""

    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
