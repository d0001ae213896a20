import random

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_simple_operators import SECRET, toxic_corpus
from vellumspark.llm import secrets, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(7)
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = [(k, t) for k, t, _ in toxic_corpus(200, 5)]
    labels = [(k, 1, x) for k, _, x in toxic_corpus(200, 5)]
    long = " ".join(f"u{rng.randrange(5000)}" for _ in range(200))
    rows += [(300, long), (301, long), (302, long + " end"), (303, long + " " + passage), (304, f"see {passage}. and password={SECRET} there"), (305, None), (306, "")]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows), {k: x for k, _, x in labels}, passage


def plain(texts, model, passage):
    """The stages one after the other, each pair and window compared."""
    score = model.scorer()
    kept = {k: t for k, t in texts.items() if score(t) < toxicity.CUT}
    sets, root = {k: shingles(t, 5) for k, t in kept.items()}, {k: k for k in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in kept:
        for j in kept:
            both = len(sets[i] & sets[j])
            if j < i and sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {k: t for k, t in kept.items() if find(k) == k}
    return {k: secrets.redact(t.replace(passage, "") if t else t) for k, t in kept.items()}


def test_stages_against_a_plain_version(spark, folder):
    path, texts, _, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(toxicity.fit_rows(docs, spark.read.parquet(f"{path}/labels.parquet")))
    want = plain(texts, model, passage)
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        before = docs
        out = stage(spark, docs, path)
        assert out.columns == before.columns
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.where("text is not null and doc_id >= 300").collect())
    mixed = P.STAGES[-1][1](spark, docs, path).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(want) and all(r.rate >= 0 and r.copies >= 0 for r in mixed)
    assert 301 not in want and passage not in " ".join(t or "" for t in want.values()) and SECRET not in want[304]
    assert words(want[303]) == words(texts[300]) if 303 in want else True


def test_run_and_empty(spark, folder, tmp_path):
    path = folder[0]
    assert P.run(spark, path).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_at_080(spark):
    base = [f"w{k}" for k in range(104)]
    assert len(shingles(" ".join(base), 5)) == 100
    # 83 of 100 sets of five words shared, but only 84 of 101 of four; 79 of 100 are too few.
    texts = [" ".join(base), " ".join(base[:87]), " ".join(base[21:])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
