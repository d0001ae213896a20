"""Numbered lines of split files, excerpts and bindings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import evidence as E
from vellumspark.sources import lines as L

FILES = {
    "one.txt": "a\nb\r\nc\rd\n\ne",
    "long.txt": "".join(f"line {k} {'x' * (k % 40)}\n" for k in range(3000)),
    "odd.txt": "a\x0bb\nc d\x85\ne\n" * 300,
    "empty.txt": "",
    "blank.txt": "\n\n",
    "sub/wide.txt": "é" * 5000 + "\nend",
}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_over_splits(spark, tmp_path, small_splits):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    numbered = L.numbered_lines(spark, f"file://{tmp_path}", recursiveFileLookup="true")
    got = {}
    for r in numbered.collect():
        got.setdefault(r.file.split(str(tmp_path) + "/")[1], []).append((r.number, r.line))
    want = {name: list(enumerate(text.splitlines(), 1)) for name, text in FILES.items() if text}
    assert {name: sorted(rows) for name, rows in got.items()} == want
    digests = {r.file.split("/")[-1]: r.sha256 for r in L.file_digests(numbered).collect()}
    assert digests == {name.split("/")[-1]: hashlib.sha256("\n".join(text.splitlines()).encode()).hexdigest() for name, text in FILES.items() if text}
    counts = {r.file.split("/")[-1]: r.lines for r in L.line_counts(numbered).collect()}
    assert counts["long.txt"] == 3000 and "empty.txt" not in counts


def test_plain_paths(spark):
    cases = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "../a": "../a", "a/../../b": "../b", "/a/./b": "/a/b", "": "", ".": ""}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", E.plain_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in got} == cases


def test_bindings(spark):
    lines = spark.createDataFrame([("src/a.py", k, f"line {k}") for k in range(1, 200)] + [("other/b.py", 1, "b")], "file string, number long, line string")
    sources = spark.createDataFrame([("s", "repository", "src", "abcd"), ("p", "paper", "src", None), ("top", "paper", "", ""), ("rootless", "paper", None, None)], "source_id string, kind string, root string, revision string")
    rows = [
        ("ok", "s", "code_demonstrated", ("file_lines", "src/a.py", 2, 3, "ab"), None), ("wide", "s", "x", ("file_lines", "src/x/../a.py", 1, 199, ""), None), ("top", "top", "x", ("file_lines", "other/b.py", 1, 1, None), None),
        ("kind", "s", "x", ("page", "src/a.py", 2, 3, None), "evidence anchor must be file_lines"), ("none", "s", "x", None, "evidence anchor must be file_lines"), ("unknown", "zz", "x", ("file_lines", "src/a.py", 1, 1, None), "EVIDENCE_SOURCE_MISMATCH: unknown source"),
        ("rootless", "rootless", "x", ("file_lines", "src/a.py", 1, 1, None), "EVIDENCE_SOURCE_MISMATCH: unknown source"), ("paper", "p", "code_demonstrated", ("file_lines", "src/a.py", 1, 1, None), "CODE_DEMONSTRATED_WRONG_SOURCE_KIND"),
        ("escape", "s", "x", ("file_lines", "src/../other/b.py", 1, 1, None), "EVIDENCE_SOURCE_MISMATCH: path"), ("sibling", "s", "x", ("file_lines", "src2/a.py", 1, 1, None), "EVIDENCE_SOURCE_MISMATCH: path"), ("absolute", "top", "x", ("file_lines", "/src/a.py", 1, 1, None), "EVIDENCE_SOURCE_MISMATCH: path"),
        ("lost", "s", "x", ("file_lines", "src/lost.py", 1, 1, None), "evidence file missing"), ("zero", "s", "x", ("file_lines", "src/a.py", 0, 1, None), "invalid evidence line range"), ("past", "s", "x", ("file_lines", "src/a.py", 190, 200, None), "invalid evidence line range"),
        ("turned", "s", "x", ("file_lines", "src/a.py", 3, 2, None), "invalid evidence line range"), ("null", "s", "x", ("file_lines", "src/a.py", None, 2, None), "invalid evidence line range"), ("revision", "s", "x", ("file_lines", "src/a.py", 1, 1, "abcde"), "EVIDENCE_SOURCE_MISMATCH: revision"),
    ]
    schema = "fact_id string, solution_id string, source_id string, evidence_type string, evidence_ids array<string>, anchor struct<kind:string,path:string,start_line:int,end_line:int,revision:string>"
    facts = spark.createDataFrame([(f, "S", s, t, [f"e-{f}", f"g-{f}"], a) for f, s, t, a, _ in rows], schema)
    bindings, errors = E.bind_evidence(facts, sources, lines)
    assert {(r.fact_id, r.evidence_id, r.error) for r in errors.collect()} == {(f, k + f, e) for f, *_, e in rows if e for k in ("e-", "g-")}
    got = {r.evidence_id: r for r in bindings.collect()}
    assert set(got) == {k + f for f in ("ok", "wide", "top", "revision") for k in ("e-", "g-")}
    assert got["e-ok"].excerpt == "line 2\nline 3" and got["e-ok"].source_revision == "ab" and got["e-wide"].excerpt_sha256 == got["e-wide"].source_file_sha256 == hashlib.sha256("\n".join(f"line {k}" for k in range(1, 200)).encode()).hexdigest()
    assert got["e-wide"].source_revision == "abcd" and got["e-top"].source_revision is None
