"""Incremental states of a vault, and source drift by reference and derivation."""

from pyspark.sql import functions as F

from vellumspark.operators import graph, maintain
from vellumspark.tables import written

NOTE = "---\ntype: learning\nderived_from: {}\n---\n# Head\n{}"
FILES = [
    ("v/a.md", NOTE.format("[]", "one [[b]]")),
    ("v/b.md", NOTE.format('["[[a]]"]', "two")),
    ("v/c.md", NOTE.format('["[[b]]", "[[d]]"]', "three")),
    ("v/d.md", NOTE.format('["[[c]]"]', "four")),
    ("v/e.md", NOTE.format("[]", "five")),
    ("v/broken.md", "---\nx y\n---\n"),
    ("v/null.md", None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_only_changed_notes_are_parsed_again(spark, tmp_path):
    first, changes = maintain.refresh(frame(spark, FILES), f"file://{tmp_path}/1")
    assert {r.change for r in changes.collect()} == {"added"}
    # What a parse would never give marks the kept rows.
    marked = written(first.table("notes").withColumn("body", F.concat("body", F.lit(" KEPT"))), "marked")
    marked.write.mode("overwrite").parquet(f"file://{tmp_path}/1/notes")
    later = [(p, t + " grown" if p == "v/b.md" else t) for p, t in FILES if p != "v/e.md"] + [("v/f.md", NOTE.format('["[[null]]"]', "six [[e]]"))]
    second, changes = maintain.refresh(frame(spark, later), f"file://{tmp_path}/2", first)
    assert {r.path: r.change for r in changes.collect()} == {"v/a.md": "same", "v/b.md": "changed", "v/c.md": "same", "v/d.md": "same", "v/e.md": "removed", "v/f.md": "added", "v/broken.md": "same", "v/null.md": "same"}
    bodies = {r.path: r.body for r in second.table("notes").collect()}
    assert {p for p, b in bodies.items() if b.endswith(" KEPT")} == {p for p, _ in FILES} - {"v/b.md", "v/e.md"} and bodies["v/b.md"].endswith("two grown")
    assert {(r.source, r.target, r.kind) for r in second.graph().edges.collect()} == {("v/a", "v/b", "wikilink"), ("v/b", "v/a", "derived_from"), ("v/c", "v/b", "derived_from"), ("v/c", "v/d", "derived_from"), ("v/d", "v/c", "derived_from"), ("v/f", "v/null", "derived_from"), ("v/f", "e", "wikilink")}
    assert {r.id for r in maintain.affected(second, changes).collect()} == {"v/b", "v/c", "v/d", "v/f"}
    third, changes = maintain.refresh(frame(spark, later), f"file://{tmp_path}/3", second)
    assert {r.change for r in changes.collect()} == {"same"} and third.table("notes").count() == len(later) and maintain.affected(third, changes).count() == 0
    for name in ("notes", "sections", "links", "places"):
        assert sorted(map(repr, third.table(name).collect())) == sorted(map(repr, second.table(name).collect()))


def test_direct_impact(spark):
    refs = [
        ("whole", "source:s1"), ("other", "source:s2"), ("file", "repo://r1@x/src/a.py#L1-L2"), ("part", "repo://r1@x/src/a.py::f"), ("deep", "repo://r1@x/lib/deep/b.py"), ("near", "repo://r1@x/library/b.py"),
        ("folder", "repo://r1@x/lib"), ("bare", "repo://r1@x"), ("unlisted", "repo://r3@x/any"), ("settled", "repo://r2@x/src/a.py"), ("lost", "repo://r4@x/src/a.py"), ("foreign", "repo://nope@x/src/a.py"), ("paper", "paper://r1@x/src/a.py"),
    ]
    sources = [("s1", "repos/r1", "old", "new"), ("s2", "repos/r2", "same", "same"), ("s3", "deep/repos/r3", "old", "new"), ("s4", "repos/r4", "old", None), ("s5", "repos/r5", None, "new")]
    changed = [("s1", "src/a.py"), ("s1", "lib/"), ("s2", "src/a.py"), ("s4", "src/a.py")]
    found = maintain.direct_impact(spark.createDataFrame(refs, "id string, ref string"), spark.createDataFrame(sources, "source_id string, path string, ingested string, current string"), spark.createDataFrame(changed, "source_id string, file string"))
    assert {(r.source_id, r.id) for r in found.collect()} == {("s1", "whole"), ("s1", "file"), ("s1", "part"), ("s1", "deep"), ("s3", "unlisted")}


def test_reach_keeps_labels_apart(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1), (5, 5)], "source long, target long")
    seeds = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9), ("c", 9), ("d", 5), ("e", 77)], "label string, id long")
    got = graph.reach(edges, seeds).collect()
    want = {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 4), ("c", 9), ("c", 1), ("c", 2), ("c", 3), ("c", 4), ("d", 5), ("e", 77)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_reach_over_many_rounds(spark):
    edges = spark.range(25).selectExpr("id as source", "id + 1 as target")
    got = graph.reach(edges, spark.createDataFrame([("a", 0), ("b", 20)], "label string, id long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a", k) for k in range(26)] + [("b", k) for k in range(20, 26)])
