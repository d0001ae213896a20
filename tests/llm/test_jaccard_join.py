import random
import re

import numpy as np
import pytest

from vellumspark.llm import jaccard_join as J

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def got(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as sig")
    return sorted(tuple(r) for r in J.jaccard_components(frame).collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return words


def corpus(seed, groups=12, size=6, vocabulary=400):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        if rng.random() < 0.5:
            base = passage + base
        chain = base
        for _ in range(rng.randrange(1, size)):
            docs.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))))
            chain = edited(rng, chain, max(1, len(base) // 60))  # drifts away step by step
            docs.append(" ".join(chain).upper())
    docs += [" ".join(passage)] * 2 + [None, "", "one", "One", "one two three", "one two three four", "  \t"]
    rng.shuffle(docs)
    return list(enumerate(docs, 5))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert got(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", ["MEMBERS", "SHINGLES"])
def test_split_lists(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(J, limit, {"MEMBERS": 4, "SHINGLES": 300}[limit])
    docs = corpus(4 + seed, groups=4, size=14)
    assert got(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", range(4))
def test_a_walk_connects_what_its_links_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        edits = rng.integers(0, 14)
        own[rng.integers(0, 80, edits)] = rng.integers(0, 1 << 60, edits)
        sets.append(np.unique(own[: rng.integers(60, 81)]))
    group, wanted = np.arange(60) // 2, rng.random(60) < 0.4
    root = group.copy()
    for i in range(60):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if (wanted[i] or wanted[j]) and 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                root[root == root[i]] = root[j]
    edges = list(J.Walk(sets, 85, group, wanted).edges())
    found = group.copy()
    for i, j in edges:
        assert found[i] != found[j]
        found[found == found[i]] = found[j]
    assert len(edges) > 5 and all((root[i] == root[j]) == (found[i] == found[j]) for i in range(60) for j in range(i))


def test_repeated_rows_and_empty(spark):
    docs = corpus(5, groups=3)
    assert got(spark, docs + docs) == sorted(brute(docs) + brute(docs))
    assert got(spark, []) == []
    assert got(spark, [(3, None), (4, "")]) == [(3, 0, 3), (4, 0, 4)]


def test_a_short_text_is_not_a_shingle_of_a_longer_one(spark):
    docs = [(1, "a b c"), (2, "a b c d"), (3, "a  b\tc"), (4, "A b c d e" + " f" * 3)]
    assert got(spark, docs) == brute(docs)


def test_words_that_power_of_two_hashes_confuse(spark):
    x, y = "a", "b"
    for _ in range(8):
        x, y = x + y, y + x
    docs = [(1, f"{x} b c d"), (2, f"{y} b c d"), (3, f"{x} b c d")]
    assert got(spark, docs) == brute(docs)


def test_rows_of_one_id_and_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    docs = [(7, "a b c d e"), (7, "p q r s t"), (3, "a b c d e"), (9, "p q r s t"), (11, long), (12, long + " end")]
    assert {tuple(r) for r in J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "component_id").collect()} == {(7, 3), (3, 3), (9, 3), (11, 11), (12, 11)}
