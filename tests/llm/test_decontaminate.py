import hashlib
import random
import re

import numpy as np
import pytest

from vellumspark.llm import decontaminate as D
from vellumspark.llm.fm_index import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            for a in range(max(1, len(w) - width + 1) if w else 0):
                window = w[a : a + width]
                for k in range(len(own) - len(window) + 1):
                    if own[k : k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 1), (40, 2), (300, 3), (1000, 50)):
        s = np.append(rng.integers(0, kinds + 1, n), 0).astype(np.int32)
        order = suffix_array(s)
        assert sorted(order.tolist()) == list(range(len(s)))
        index = FMIndex(s)
        for length in (1, 2, 4):
            patterns = rng.integers(1, kinds + 2, (30, length)).astype(np.int32)
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [k for k in range(len(s) - length + 1) if (s[k : k + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def rows(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.digest_contamination(D.find_contamination(d, b, **options))
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["ab", "cd", "éf", "Gh", "i9", "jk", "lm"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 5, 12, 30]))) for k in range(12)] + [(90, None), (91, " .. "), (3, say(11))]
    docs = [(k, say(rng.randrange(0, 200))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "xx " + items[4][1].upper() + " yy " + items[4][1]), (102, "xx"), (103, say(5000))]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    assert rows(spark, docs, items) == brute(docs, items)


def test_long_windows_only(spark):
    docs, items = corpus(2)
    items = [x for x in items if len(words(x[1])) >= 11]
    docs += [(200 + k, f"zz {text} zz {text}") for k, (_, text) in enumerate(items)]
    got = rows(spark, docs, items)
    assert got == brute(docs, items) and any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert rows(spark, docs, items) == brute(docs, items)


def test_many_rows(spark):
    docs, items = corpus(4)
    assert rows(spark, docs * 3, items) == brute(docs * 3, items)


def test_empty_tables(spark):
    docs, items = corpus()
    assert rows(spark, [], items) == []
    assert all(r[2] == 0 and not r[-1] for r in rows(spark, docs, []))


def test_spans_are_cut(spark):
    phrase = "uno dos tres cuatro cinco seis siete ocho nueve diez once"
    d = spark.createDataFrame([(1, f"é Antes. {phrase.title()}! después é", 7, "x"), (2, "nada", None, None), (3, None, 1, "y")], "doc_id long, text string, n_chars long, items string")
    b = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = {r.doc_id: r for r in D.remove_contamination(d, b).collect()}
    assert got[1].text == "é Antes. ! después é" and got[1].n_chars == len(got[1].text) and got[1]["items"] == "x"
    assert got[2].text == "nada" and got[2].n_chars is None and got[3].text is None


@pytest.mark.parametrize("text", ["", "a" * 3_000_000, "word " * 200_000])
def test_very_long_texts(spark, text):
    got = rows(spark, [(1, text)], [(1, "word word")])
    assert got[0][1] == len(text.split()) and got[0][2] == (200_000 if " " in text else 0)


def collide(first="a", second="b", doublings=8):
    """Two different words of 256 letters that a polynomial modulo a power of two cannot tell apart."""
    x, y = first, second
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def test_words_that_power_of_two_hashes_confuse(spark):
    x, y = collide()
    tail = " one two three four five six seven eight nine"
    docs, items = [(1, x + tail), (2, y + tail), (3, tail)], [(1, x + tail)]
    assert rows(spark, docs, items) == brute(docs, items)


def test_several_shards(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(D, "SHARD_BYTES", 1000)
    shared = type("Shared", (), {"value": [(str(i), t) for i, t in items]})
    import pyarrow as pa

    table = pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    made, full = [], D.Shard.full
    monkeypatch.setattr(D.Shard, "full", lambda self: (made.append(full(self)), made[-1])[1])
    out = list(D._pass(shared, 10, 1, False)([b.slice(k, 2) for b in table.to_batches() for k in range(0, b.num_rows, 2)]))
    assert sum(made) > 3
    got = [(i, n, sum(s["end_word"] - s["first_word"] for s in spans), items) for c in out for i, n, spans, items in zip(*(x.to_pylist() for x in (c[0], *c[-3:])))]
    want = sorted(brute(docs, items), key=str)
    assert sorted([(i, n, h, len(own)) for i, n, h, own in got], key=str) == sorted([r[:4] for r in want], key=str)


def test_clashing_columns_and_items_without_id(spark):
    d = spark.createDataFrame([(1, "alpha beta", "s", "i", 1), (2, "gamma", "s", "i", 2)], "doc_id long, text string, _spans string, _items string, __spans int")
    b = spark.createDataFrame([(None, "alpha"), (None, "beta"), ("null", "beta")], "item_id string, text string")
    found = D.find_contamination(d, b)
    assert found.columns[:5] == d.columns and [tuple(r) for r in found.select("_spans", "__spans").collect()] == [("s", 1), ("s", 2)]
    got = {r.doc_id: r for r in D.digest_contamination(found).collect()}
    assert got[1].n_items == 2 and got[1].items_sha256 == hashlib.sha256(b"null").hexdigest() and got[2].n_items == 0
    assert {r.text for r in D.remove_contamination(d, b).collect()} == {"", "gamma"}
