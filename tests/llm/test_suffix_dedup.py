import hashlib
import random

import pytest

from vellumspark.llm import suffix_dedup as S


def brute(docs, length):
    starts = {}
    data = [(t or "").encode() for _, t in docs]
    for d in data:
        for k in range(len(d) - length + 1):
            w = d[k : k + length]
            starts[w] = starts.get(w, 0) + 1
    out = []
    for (i, _), d in zip(docs, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if starts[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, length):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as core", "'x' as spans")
    return sorted((tuple(r) for r in S.digest_repeats(S.remove_repeats(frame, length=length)).collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    passages = [say(rng.randrange(10, 120)) for _ in range(6)]
    docs = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += say(rng.randrange(0, 30)) + rng.choice([p, p[a:], p[:a]])
        docs.append(text)
    docs += [docs[0], docs[3] + "x", "x" + docs[3], None, "", "ab" * 60, "a" * 90, say(20) * 3]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,length", [(1, 20), (2, 20), (3, 11), (4, 50)])
def test_against_brute_force(spark, seed, length):
    docs = corpus(seed)
    assert got(spark, docs, length) == brute(docs, length)


@pytest.mark.parametrize("hot,huge", [(2, 1 << 16), (2, 3), (2, 2)])
def test_hot_cores_and_repeated_rows(spark, monkeypatch, hot, huge):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HUGE", huge)
    docs = corpus(5)
    docs += [docs[1], docs[2], (None, "q" * 30), (7, "other text under a used id, which stays")]
    assert got(spark, docs, 20) == brute(docs, 20)


def test_empty_and_long(spark):
    assert got(spark, [], 20) == []
    docs = [(1, "z" * 400_000), (2, None)]
    assert got(spark, docs, 200)[0][2] == 400_000
