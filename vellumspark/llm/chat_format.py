"""Chat formatting with loss masks aligned to token offsets.

A whole conversation is rendered as one string, encoded once with the byte
offset of each token, and the sorted spans of its assistant turns are
intersected with the token spans by binary search; the tokens inside form the
loss mask.  Control strings are single tokens, so no token straddles a turn.

Rendering of a turn: ``<|turn|>role<|text|>text</s>``.  Inside roles and texts
a backslash is doubled and a backslash is put behind the first character of
anything that reads like a control string, which :func:`unescape` reverts.

Defined cases: null role or text is empty; turns go by turn number, nulls
first, ties by role, then text; a null conv_id is a conversation of its own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: Strings that a template or a tokenizer may take for control.
CONTROL = (TURN, TEXT, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_ESCAPE = re.compile("\\\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")
_PARSE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the character spans of its loss texts, in order."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        pieces += [head, body, END]
    return "".join(pieces), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _PARSE.findall(formatted)]


@lru_cache(maxsize=2)
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    from .token_counts import encoding

    base = encoding(ranks_path)
    ranks = base._mergeable_ranks
    marks = {mark: len(ranks) + k for k, mark in enumerate((TURN, TEXT, END))}
    own = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
    width = np.zeros(len(ranks) + len(marks), np.int64)
    for piece, rank in ranks.items():
        width[rank] = len(piece)
    for mark, k in marks.items():
        width[k] = len(mark)
    return own, width


def encode_with_offsets(formatted: str, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their byte edges: token k covers edges[k] to edges[k + 1]."""
    encoder, width = _encoder(ranks_path)
    ids = np.array(encoder.encode(formatted, allowed_special="all"), dtype=np.int64)
    return ids, np.concatenate([[0], np.cumsum(width[ids])]).astype(np.int64)


def loss_mask(edges: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted, disjoint byte spans."""
    mask = np.zeros(len(edges) - 1, bool)
    if len(spans) and len(mask):
        first, end = edges[:-1], edges[1:]
        k = np.searchsorted(spans[:, 0], first, side="right") - 1
        near = spans[np.maximum(k, 0)]
        mask = (k >= 0) & (first < near[:, 1]) & (end <= near[:, 1])
    return mask


def format_turns(turns: list[tuple[str, str]], ranks_path: str, loss_role: str = "assistant") -> dict:
    formatted, spans = render(turns, loss_role)
    data = formatted.encode()
    if len(data) == len(formatted):
        byte_spans = np.array(spans, np.int64).reshape(-1, 2)
    else:
        widths = np.frombuffer(formatted.encode("utf-32-le"), np.uint32)
        sizes = 1 + (widths >= 0x80) + (widths >= 0x800) + (widths >= 0x10000)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        byte_spans = edge[np.array(spans, np.int64).reshape(-1, 2)]
    ids, edges = encode_with_offsets(formatted, ranks_path)
    return {"formatted": formatted, "ids": ids, "edges": edges, "mask": loss_mask(edges, byte_spans), "data": data}


def loss_texts(data: bytes, edges: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches under the mask, unescaped."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(data[edges[a] : edges[b]].decode()) for a, b in zip(change[::2], change[1::2])]


OUTPUT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("token_edges", T.ArrayType(T.LongType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
    ]
)
_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("token_edges", pa.list_(pa.int64())), ("loss_mask", pa.list_(pa.bool_()))])


def _stream(ranks_path: str, loss_role: str):
    def flush(rows):
        made = [(cid, format_turns(turns, ranks_path, loss_role)) for cid, turns in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in made], pa.int64()),
                pa.array([m["formatted"] for _, m in made], pa.string()),
                pa.array([m["ids"] for _, m in made], pa.list_(pa.int32())),
                pa.array([m["edges"] for _, m in made], pa.list_(pa.int64())),
                pa.array([m["mask"] for _, m in made], pa.list_(pa.bool_())),
            ],
            schema=_ARROW,
        )

    def run(batches):
        current, turns, ready, held = (), [], [], 0
        for batch in batches:
            for cid, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if current and current[0] != cid:
                    ready.append((current[0], turns))
                    turns = []
                    if held > 1 << 20:
                        yield flush(ready)
                        ready, held = [], 0
                current = (cid,)
                turns.append((role, text))
                held += len(text) + 32
        if current:
            ready.append((current[0], turns))
        if ready:
            yield flush(ready)

    return run


def format_conversations(conversations: DataFrame, ranks_path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the rendered string, its token ids, their byte
    edges and the loss mask.  One conversation is held in memory at a time."""
    empty = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.col("turn").cast("long"))
    spark = conversations.sparkSession
    ordered = turns.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_stream(ranks_path, loss_role), OUTPUT)


DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


def _digest_batches(batches):
    schema = pa.schema([(f.name, pa.string() if f.name.endswith("sha256") else pa.int64()) for f in DIGEST])
    for batch in batches:
        rows = []
        for cid, formatted, edges, mask in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "token_edges", "loss_mask"))):
            turns = parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(loss_texts(formatted.encode(), np.array(edges, np.int64), np.array(mask, bool)))
            rows.append((cid, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(mask), sum(mask)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from :func:`format_conversations`."""
    return formatted.select("conv_id", "formatted", "token_edges", "loss_mask").mapInArrow(_digest_batches, DIGEST)
