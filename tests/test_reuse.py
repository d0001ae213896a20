"""Interval joins against brute force; declared reuse on a small vault."""

import random

import pytest

from vellumspark.operators import intervals as I
from vellumspark.operators import knowledge_graph, reuse
from vellumspark.sources import vault


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    points = [(k, key(), rng.choice([None, *range(-50, 300)])) for k in range(400)]
    edges = [(k, key(), low, low + rng.randrange(-3, 80)) for k, low in enumerate(rng.choices(range(-60, 300), k=150))] + [(900, "a", None, 5), (901, "a", 5, None), (902, "hot", -1000, 1000)]
    p = spark.createDataFrame(points, "p long, note string, bucket long")
    e = spark.createDataFrame(edges, "e long, note string, low long, high long")
    want = {(a, b) for a, k, at in points for b, n, low, high in edges if k is not None and k == n and None not in (at, low, high) and low <= at <= high}
    got = I.interval_join(p, e, ["note"], "bucket", "low", "high", bucket=bucket)
    assert got.columns == ["p", "note", "bucket", "e", "low", "high"]
    assert {(r.p, r.e) for r in got.collect()} == want and got.count() == len(want)
    semi = I.interval_join(p, e, ["note"], "bucket", "low", "high", "left_semi", bucket)
    assert sorted(r.p for r in semi.collect()) == sorted({a for a, _ in want})
    left = I.interval_join(p, e, ["note"], "bucket", "low", "high", "left", bucket)
    assert left.count() == len(want) + len(points) - len({a for a, _ in want})


def test_plan_joins_on_equal_keys(spark):
    p, e = spark.range(5).selectExpr("id as note", "id as at"), spark.range(5).selectExpr("id as note", "id as low", "id as high")
    plan = I.interval_join(p, e, ["note"], "at", "low", "high")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_declared_reuse(spark):
    files = [
        ("v/P.md", "---\ntype: project\n---\n# P\n[[L]] outside\n## Applications\nused [[L]] and [[L]] and [[Q]]\n### Detail\n![[v/sub/L2|x]]\n## Later\n[[L]]\n```\n# Applications\n[[L]]\n```"),
        ("v/D.md", "---\ntype: project-doc\nderived_from: [\"[[L]]\"]\n---\n# 应用记录\n[[L]]"),
        ("v/L.md", "---\ntype: learning\n---\n# Applications\n[[L2]]"),
        ("v/sub/L2.md", "---\ntype: learning\n---\nx"),
        ("v/Q.md", "---\ntype: paper\n---\n# Applications\n[[L]]"),
    ]
    notes = vault.notes(spark.createDataFrame(files, "path string, text string"))
    found = reuse.reuse_report(knowledge_graph.build_graph(notes).edges, notes, vault.sections(notes)).collect()
    assert sorted((r.project_note, r.learning, r.line, r.record) for r in found) == [
        ("v/D", "v/L", 6, "# 应用记录\n[[L]]"),
        ("v/P", "v/L", 7, "## Applications\nused [[L]] and [[L]] and [[Q]]"),
        ("v/P", "v/sub/L2", 9, "### Detail\n![[v/sub/L2|x]]"),
    ]
