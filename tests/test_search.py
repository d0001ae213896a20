"""The search index against a plain scoring of every note."""

import math
import random
import re

import pytest

from vellumspark.functions.markdown import parse_note, sections
from vellumspark.operators import search as S
from vellumspark.sources import vault

ODD = [
    ("v/Deep-Learning.md", "---\ntype: learning\naliases: [\"net's\", 神经网络]\nlearning_kind: mechanism\n---\nintro\n# One\nloss and loss\n## Two\nloss gradient"),
    ("v/plan.md", "---\ntype: project-doc\ntags: gradient\n---\n# 概述\n神经网络 gradient\n# Later\nnothing"),
    ("v/sub/plan-b.md", "no properties, straße\n\ngradients of the loss"),
    ("v/sub/plan-b-c.md", "no properties, straße\n\ngradients of the loss"),
    ("v/empty.md", ""),
    ("v/bad.md", "---\ntype: learning\nx y z\n---\ngradient"),
    ("v/long.md", "gradient " + "filler " * 60_000 + "\n# End\nloss"),
]
QUERIES = ["loss gradient", "Gradient", "radien", "of the", "神经", "网络 gradient", "STRASSE", "loss", "net's", "zzz", "", " ... ", "lossy", "e", "deep learning", "straße\n\ngradients of", "['net", "the a", "none of it"]


def made(seed):
    rng = random.Random(seed)
    bag = ["loss", "gradient", "the", "a", "of", "网络", "学习", "Deep", "x_1", "loss,", "(a", "straße", "\n", "\n# Head\n", "\n## Sub\n"]
    rows = [(f"v/n{k}.md", ("---\ntype: learning\naliases: [a b, 'of']\n---\n" if k % 3 == 0 else "") + " ".join(rng.choice(bag) for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    return rows + ODD


def words(text):
    runs = re.findall("[一-鿿]+", text)
    return [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text)] + [c for r in runs for c in r] + [a + b for r in runs for a, b in zip(r, r[1:])]


def plain(rows, query, k):
    q, notes = set(words(query)), []
    for path, text in rows:
        note = parse_note(text)
        p = {key: v if key in note.lists else v[0] for key, v in note.properties.items()}
        aliases = p.get("aliases", [])
        title = path.split("/")[-1][:-3].replace("-", " ") + " " + " ".join(aliases if isinstance(aliases, list) else [aliases])
        props = " ".join(str(v) for v in p.values())
        notes.append((path, note, p.get("type"), title, props, words(f"{title} {props} {note.body}"), f"{title} {props} {note.body}"))
    mean = max(1, sum(len(n[5]) for n in notes) / len(notes))
    df = {t: sum(t in n[5] for n in notes) for t in q}
    hits = []
    for path, note, kind, title, props, bag, whole in notes:
        score = 0.0
        for t in q & set(bag):
            tf = bag.count(t)
            score += math.log(1 + (len(notes) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.65 + 0.35 * len(bag) / mean))
            score += 2 if t in words(title) else 0.5 if t in words(props) else 0
        score += 2.5 * (query.strip().casefold() in whole.casefold())
        score *= {"learning": 1.25, "project-doc": 1.35}.get(kind, 1)
        if q and score:
            weigh = lambda s: round(sum(math.log(1 + (len(notes) + 0.5) / (df[t] + 0.5)) for t in q & set(words(s["body"]))), 9)
            best = min(sections(note.body, note.offset), key=lambda s: (-weigh(s), s["start_line"]), default=None)
            hits.append((round(score, 5), path, sorted(q & set(bag)), best and best["anchor"], best and best["start_line"]))
    return sorted(hits, key=lambda h: (-h[0], h[1]))[:k]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(1)
    return rows, S.build_index(vault.notes(spark.createDataFrame(rows, "path string, text string")), f"file://{tmp_path_factory.mktemp('index')}", buckets=4, splits=2)


def test_many_queries_at_once(spark, index):
    rows, stored = index
    cases = spark.createDataFrame(list(enumerate(QUERIES)) + [(98, None), (99, "loss gradient")], "case_id long, query string")
    got = {}
    for r in stored.search_all(cases, 7).collect():
        got.setdefault(r.case_id, []).append((r["rank"], r.score, r.path, r.matched_terms, r.anchor, r.start_line))
    for k, query in [*enumerate(QUERIES), (98, ""), (99, "loss gradient")]:
        want = plain(rows, query, 7)
        assert [h[1:] for h in sorted(got.get(k, []))] == want, query
        assert [h[0] for h in sorted(got.get(k, []))] == list(range(1, len(want) + 1))


def test_one_query(index):
    rows, stored = index
    hits = stored.search("loss gradient", 3).collect()
    assert [(h.score, h.path) for h in hits] == [h[:2] for h in plain(rows, "loss gradient", 3)]
    deep = next(h for h in stored.search("loss gradient", 100).collect() if h.path == "v/Deep-Learning.md")
    assert (deep.heading, deep.heading_path, deep.start_line, deep.end_line, deep.snippet, deep.type, deep.learning_kind) == ("Two", ["One", "Two"], 9, 10, "## Two loss gradient", "learning", "mechanism")
    assert stored.search("loss", 0).count() == 0 and stored.search("...").count() == 0


def test_only_the_terms_buckets_are_read(spark, index):
    _, stored = index
    keys = spark.createDataFrame([("loss",)], "key string")
    plan = stored._read("postings", keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert stored._read("postings", keys).where("term = 'loss'").count() == stored._read("postings").where("term = 'loss'").count()


def test_excerpt():
    assert S.excerpt("a\n\n  b \r\nc", ["zz"]) == "a b c"
    long = "x " * 100 + "needle" + " y" * 200
    assert S.excerpt(long, ["needle"]).startswith("...") and "needle" in S.excerpt(long, ["NEEDLE"]) and len(S.excerpt(long, ["needle"])) == 186


def test_evaluation(spark, index):
    _, stored = index
    cases = spark.createDataFrame([(1, "loss gradient"), (2, "神经网络"), (3, "zzz")], "case_id long, query string")
    hits = stored.search_all(cases, 70)
    suite = spark.createDataFrame([(1, ["v/Deep-Learning", "v/Deep-Learning"], ["GRADIENT", "absent"]), (2, ["v/plan", "v/nowhere"], None), (3, ["v/plan"], [])], "case_id long, expected_ids array<string>, required_terms array<string>")
    rows = {r.case_id: r for r in S.evaluate(hits, suite).collect()}
    place = next(h["rank"] for h in hits.collect() if h.case_id == 1 and h.id == "v/Deep-Learning")
    assert (rows[1].recall, rows[1].reciprocal_rank, rows[1].missing_terms, rows[1].passed) == (1.0, 1 / place, ["absent"], False)
    assert (rows[2].recall, rows[2].missing_terms, rows[2].passed) == (0.5, [], False) and (rows[3].recall, rows[3].reciprocal_rank) == (0.0, 0.0)
    total = S.evaluation_summary(S.evaluate(hits, suite)).first()
    assert (total.case_count, total.passed, total.mean_recall_at_k) == (3, 0, 0.5)
    with pytest.raises(ValueError):
        S.evaluate(hits, spark.createDataFrame([(1, [], [])], suite.schema))


def test_empty_vault(spark, tmp_path):
    stored = S.build_index(vault.notes(spark.createDataFrame([], "path string, text string")), f"file://{tmp_path}/index")
    assert stored.search("loss").count() == 0


def test_snippet_of_lines_with_digits_at_their_ends(spark):
    from pyspark.sql import functions as F

    from vellumspark.functions.text import snippet

    rows = [(0, "  call 0630 zu 100"), (1, "00\n 11 \n\n22 erst 2"), (2, "a\t\nb")]
    got = spark.createDataFrame(rows, "id int, text string").select("id", snippet("text", F.array(F.lit("erst"), F.lit("zu"))).alias("s")).collect()
    assert dict(got) == {0: "call 0630 zu 100", 1: "00 11 22 erst 2", 2: "a\t b"}


def test_phrases_letter_by_letter_and_with_their_ends(spark, tmp_path):
    files = spark.createDataFrame([("v/a.md", "we meet die straße\nthen"), ("v/b.md", "we meet die strasse then"), ("v/c.md", "we meet die STRAßE at ten")], "path string, text string")
    notes = vault.notes(files, root="v").cache()
    cases = spark.createDataFrame([(0, "die stras", "die stras"), (1, "die straße", "die straße\n"), (2, "die straße", "die straße")], "case_id long, query string, phrase string")
    found = lambda fold, cases: {(r.case_id, r.path[2]) for index in [S.build_index(notes, f"{tmp_path}/{fold}", fold=fold)] for r in index.phrase_notes(index._asked(cases)).collect()}
    assert found("lower", cases) == {(0, "b"), (1, "a"), (2, "a"), (2, "c")}
    assert found("casefold", cases.drop("phrase")) == {(k, note) for k in range(3) for note in "abc"}
