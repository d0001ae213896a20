import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import attention as A
from vellumspark.llm import lm_score as L
from vellumspark.llm.token_counts import encoding, tokenizer_files

RANKS = tokenizer_files("byte_bpe_50k.json")[1]


def made(seed=0, ids=60):
    rng = np.random.default_rng(seed)
    counts = np.zeros(L.VOCABULARY, np.int64)
    counts[rng.choice(L.VOCABULARY, ids, replace=False)] = rng.integers(1, 50, ids)
    counts[L.END] = 9
    vocabulary = A.Vocabulary(counts, A.CLASSES)
    w = {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in A.first_weights(vocabulary, seed).items()}
    return w, vocabulary, np.flatnonzero(counts).astype(np.uint16)


def plain(w, vocabulary, ids):
    """One target at a time, over the inputs its window shows it."""
    w = {k: v.astype(float) for k, v in w.items()}
    inputs, targets = vocabulary.place[np.append(L.END, ids)], np.append(ids, L.END)
    e = w["E"][inputs]
    e[1:] += w["E"][inputs[:-1]] @ w["S"]
    total = 0.0
    for t, target in enumerate(targets):
        at = np.arange(max(0, (t // A.STRIDE - 1) * A.STRIDE), t + 1)
        a = np.exp(e[t] @ w["Q"] @ (e[at] @ w["K"]).T / np.sqrt(A.WIDTH) + w["R"][t - at])
        u = e[t] + a / a.sum() @ (e[at] @ w["V"])
        h = u + np.maximum(u @ w["A"] + w["a"], 0) @ w["B"]
        logits = h @ w["C"] + w["c"]
        kind, rank = vocabulary.classes[target], vocabulary.rank[target]
        total += logits[kind] - np.log(np.exp(logits).sum())
        first, end = vocabulary.edge[kind], vocabulary.edge[kind + 1]
        if rank >= vocabulary.narrow:
            total += vocabulary.share[rank]
        elif end - first > 1:
            inner = w["U"][first:end] @ h + w["u"][first:end]
            total += inner[rank - first] - np.log(np.exp(inner).sum())
    return total / np.log(10)


@pytest.mark.parametrize("size", [1, 2, 3, 200])
def test_windows_score_each_id_once(monkeypatch, size):
    monkeypatch.setattr(L, "PASS", size)
    w, vocabulary, ids = made()
    rng = np.random.default_rng(1)
    texts = [rng.choice(ids, n) for n in (0, 1, A.STRIDE - 1, A.STRIDE, 0, 7 * A.STRIDE + 5, 3)] + [np.array([7, 9, 11], np.uint16)]
    got = L.score_texts(w, vocabulary, [t.tobytes() for t in texts])
    assert np.allclose(got, [plain(w, vocabulary, t) for t in texts], rtol=1e-4)


def test_chances_sum_to_one():
    w, vocabulary, ids = made(2)
    for before in ([], [ids[3], ids[5]]):
        x, y, first = A.cut_blocks(np.array(before, np.uint16), L.END)
        block, place, total = A.Block(w, vocabulary, vocabulary.place[x], first), len(before), 0.0
        for a in range(0, L.VOCABULARY, 1000):
            some = np.arange(a, min(a + 1000, L.VOCABULARY))
            block.h = np.repeat(A.Block(w, vocabulary, vocabulary.place[x], first).h[place : place + 1], len(some), 0)
            total += np.exp(block.logs(some)).sum()
        assert abs(total - 1) < 1e-3


def test_gradients_match_differences():
    w, vocabulary, ids = made(3)
    w = {k: v.astype(float) for k, v in w.items()}
    rng = np.random.default_rng(4)
    x, y, first = A.cut_blocks(rng.choice(ids, 4 * A.STRIDE + 9), L.END)
    x, first = vocabulary.place[x], first.copy()
    first[3] = True  # two texts
    y[0] = -1  # a context block

    def loss():
        return -A.Block(w, vocabulary, x, first, 2).logs(y).sum() / (y >= 0).sum()

    g = A.Block(w, vocabulary, x, first, 2).logs(y, gradient=True)[1]
    for k in w:
        at, own = tuple(s // 2 for s in w[k].shape), g[k]
        if k == "E":
            at, own = (int(g["rows"][5]), 1), dict(zip(g["rows"].tolist(), g["E"]))
        old, ends = w[k][at], []
        for step in (1e-4, -1e-4):
            w[k][at] = old + step
            ends.append(loss())
        w[k][at] = old
        found = own[at[0]][1] if k == "E" else own[at]
        assert abs((ends[0] - ends[1]) / 2e-4 - found) < 2e-5, k


def test_tasks_reuse_memory():
    """Arrays of a pass lie where those of the pass before lay: without that, a pass takes thousands of page faults."""
    code = """if True:
        import resource
        import numpy as np
        from tests.llm.test_lm_score import A, L, made
        from types import SimpleNamespace
        import pyarrow as pa
        w, vocabulary, ids = made()
        texts = [np.random.default_rng(k).choice(ids, 60000).tobytes() for k in range(4)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(range(4)), pa.array(texts)], names=["id", "h", "ids"])
        run = L._score(SimpleNamespace(value=(L.pack_weights(w), vocabulary)))
        faults = []
        for _ in run(batch for _ in range(6)):
            faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
        print(faults[-1] - faults[1])
    """
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) < 4000, done.stdout


def test_passes_hold_little():
    """Embeddings serve as keys and values, and no array of logits is copied to add biases: a pass is bound by the memory it
    walks through.  With keys and values of their own it held 1891 bytes an input."""
    w, vocabulary, ids = made()
    x, y, first = A.cut_blocks(np.random.default_rng(1).choice(ids, 512 * A.STRIDE - 1), L.END)
    tracemalloc.start()
    A.Block(w, vocabulary, vocabulary.place[x], first).logs(y, gradient=True)
    held = tracemalloc.get_traced_memory()[1] / x.size
    tracemalloc.stop()
    assert held < 1600, held


def test_logits_beyond_the_limit():
    """They are cut off, and chances stay finite."""
    w, vocabulary, ids = made(5)
    w = {k: v * (200 if k in "QCU" else 1) for k, v in w.items()}
    x, y, first = A.cut_blocks(ids, L.END)
    logs, g = A.Block(w, vocabulary, vocabulary.place[x], first).logs(y, gradient=True)
    assert np.isfinite(logs).all() and all(np.isfinite(v).all() for v in g.values())


def test_ids_are_those_of_the_words():
    encode = encoding(RANKS).encode_ordinary
    for text in ("", "a B  c\n\n d\r\n", " x y \x0b z", "Été 12 it's…\t\t! K a\xa0b", "w" * 70 + " " + "é" * 80):
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", text)]
        assert np.frombuffer(L.subword_ids(text, RANKS), np.uint16).tolist() == [i for w in words for i in encode(" " + w)]


def documents(n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)] + ["The", "the,"]
    docs = [(int(k), " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (None, "the end"), (5, docs[5][1]), (n + 2, "unseen " * 3000)]


def test_base_against_plain_counts(spark):
    docs = documents()
    got = {(r.doc_id, r.n_tokens): r for r in L.score_documents(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as h")).collect()}
    train, rows = {}, []
    for i, text in docs:
        tokens = [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(), None]
        out = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        rows.append((i, out, tokens))
        for t in tokens if not out else []:
            train[t] = train.get(t, 0) + 1
    total, kinds = sum(train.values()), len(train)
    assert len(got) == len({(i, len(t)) for i, _, t in rows})
    for i, out, tokens in rows:
        r = got[(i, len(tokens))]
        want = sum(np.log10((train.get(t, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        assert (r.held_out, r.n_known, r.train_tokens) == (out, sum(t in train for t in tokens), total)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0


def test_learns_and_empty(spark):
    """Held-out texts score better than by words alone, and better than with the block's output or its attention off."""
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000").select("doc_id", "text").repartition(4, "doc_id")
    docs = [tuple(r) for r in frame.collect()]
    held = [r for r in L.score_documents(frame).collect() if r.held_out]
    model, base, words = (sum(r[k] for r in held) for k in ("score", "base_score", "n_tokens"))
    print(model / words, base / words)
    assert len(held) > 80 and model / words > base / words + 0.05
    rows = frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = rows.mapInArrow(L._encode(RANKS), L._IDS).selectExpr("h", "train", "ids")
    state, vocabulary = L.train_model(encoded)
    w, texts = L.unpack_weights(state, vocabulary), [L.subword_ids(t or "", RANKS) for k, t in docs if zlib.crc32(str(k).encode()) % 10 == 0]
    words = sum(len(x) // 2 + 1 for x in texts)
    whole = L.score_texts(w, vocabulary, texts).sum()
    off = {k: L.score_texts({**w, **{n: w[n] * 0 for n in names}}, vocabulary, texts).sum() for k, names in (("block", "ESVB"), ("attention", "V"))}
    assert whole > off["block"] + 0.3 * words and whole > off["attention"] + 0.05 * words
    few = spark.createDataFrame(documents(), "doc_id long, text string")
    assert L.score_documents(few.where("false")).count() == 0
    assert L.score_documents(few.where("doc_id = 121")).count() == 1


def test_words_that_power_of_two_hashes_confuse(spark):
    x, y = "a", "b"
    for _ in range(8):
        x, y = x + y, y + x
    got = {r.doc_id: r for r in L.score_documents(spark.createDataFrame([(1, x), (6, y)], "doc_id long, text string")).collect()}
    assert got[6].held_out and got[6].n_known == 1 and got[1].n_known == 2


@pytest.mark.parametrize("n", [1, 2])
def test_repeated_rows(spark, n):
    frame = spark.createDataFrame([(1, "a b")] * n, "doc_id long, text string")
    assert len(L.score_documents(frame).collect()) == n
