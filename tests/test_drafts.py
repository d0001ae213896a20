"""Draft proofs against hand-made cases."""

from vellumspark.operators import drafts as D


def known(spark):
    facts = spark.createDataFrame([("F-1",), ("F-2",), (None,)], "fact_id string")
    claims = spark.createDataFrame([("C-all", "all", 3, 3), ("C-part", "all", 2, 3), ("C-two", "exact_count", 2, 5), ("C-five", "exact_count", 5, 5), ("C-open", "all", None, None), ("C-two", "exact_count", 2, 5)], "claim_id string, coverage_mode string, support_count long, eligible_count long")
    return D.artifacts(facts, claims, spark.createDataFrame([("M-1",)], "mechanism_id string"))


def mark(*refs):
    return f"<!-- KOS:refs={','.join(refs)} -->"


CASES = {
    "plain": (mark("F-1", "M-1") + "\nnothing general", []),
    "unknown": (mark("F-1", "F-9", "Z") + "\ntext", [(0, "UNKNOWN_REFS", "F-9,Z")]),
    "covered": (mark("C-all") + "\nAll of them.", []),
    "partly": (mark("C-part", "F-1") + "\nAll of them.", [(0, "UNIVERSAL_WORDING_UNVERIFIED", "")]),
    "no claim": ("before, all of it\n" + mark("F-2") + "\nevery one" + mark("C-all") + "every one", [(0, "UNIVERSAL_WORDING_UNVERIFIED", "")]),
    "counted": (mark("C-two", "C-five") + "\nOnly two methods of 5 solutions", []),
    "miscounted": (mark("C-two", "C-all") + "\nOnly 2 methods of 5 solutions", [(0, "UNIVERSAL_WORDING_UNVERIFIED", "2,5")]),
    "count without wording": (mark("C-two") + "\n9 methods", []),
    "uncounted claim": (mark("C-open") + "\n全部", []),
    "blank refs": (mark(" , ") + "\nnever", [(0, "UNIVERSAL_WORDING_UNVERIFIED", "")]),
    "no blocks": ("all", []),
    "empty": ("", []),
    "null": (None, []),
    "long": (mark("F-1") + "\n" + "word " * 200_000 + mark("nope") + "x", [(1, "UNKNOWN_REFS", "nope")]),
}


def test_blocks(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "draft string, text string")
    got = D.block_errors(D.block_proofs(D.traced_blocks(frame), known(spark))).collect()
    assert sorted((r.draft, r.block, r.code, r.detail) for r in got) == sorted((k, *e) for k, (_, errors) in CASES.items() for e in errors)
    assert D.block_errors(D.block_proofs(D.traced_blocks(frame.where("false")), known(spark))).count() == 0


def test_whole_drafts(spark):
    rows = [
        ("good", "---\na: b\n---\n# Evidence map\nThe Label\n" + "x" * 30),
        ("thin", "---\na: " + "b" * 50 + "\n---\n\n ## EVIDENCE MAP\nThe Label"),
        ("regex", "## Evidence Mapping\n### Scope (1)\nThe label repo://x"),
        ("free", "sources/repos/x"),
        ("none", None),
    ]
    frame = spark.createDataFrame(rows, "draft string, text string")
    contracts = spark.createDataFrame([(k, ["Evidence Map", "Scope (1)"] if k == "regex" else ["Evidence Map"], ["The Label"], 20) for k in ("good", "thin", "regex", "none")], "draft string, sections array<string>, labels array<string>, min_chars int")
    got = {(r.draft, r.code, r.detail) for r in D.draft_errors(frame, contracts).collect()}
    missing = "DOCUMENT_COMPLETENESS_FAIL"
    assert got == {
        ("thin", missing, "section Evidence Map"),
        ("regex", missing, "section Evidence Map"),
        ("regex", missing, "label The Label"),
        ("regex", "MACHINE_PATH_LEAK", ""),
        ("free", "MACHINE_PATH_LEAK", ""),
        ("none", missing, "section Evidence Map"),
        ("none", missing, "label The Label"),
        ("none", "SUSPICIOUSLY_THIN_OUTPUT", "0"),
    }


def test_stale_artifacts(spark):
    gates = spark.createDataFrame([("d", "facts", "1"), ("d", "claims", "2"), ("e", "facts", "3")], "draft string, artifact string, digest string")
    now = spark.createDataFrame([("d", "facts", "1"), ("d", "claims", "9")], "draft string, artifact string, digest string")
    assert {tuple(r) for r in D.stale_artifacts(gates, now).collect()} == {("d", "STALE_HASHES", "claims"), ("e", "STALE_HASHES", "facts")}
