"""Bundles as real files: scan, index in versions, audit."""

import hashlib
import json

from vellumspark.operators import bundles as B

sha = lambda data: hashlib.sha256(data).hexdigest()


def seal(folder, run, output="v/o.md", text="final", region=None, region_sha256=None, at="2024-01-01", **changes):
    files = {"run.json": json.dumps({"state": "COMMITTED", "finalization": {"output": output, "finalized_at": at}}), "facts.jsonl": "{}", "claims.jsonl": "", "mechanisms.jsonl": "", "draft-trace.json": "{}", "gate.json": "{}", "final-output.md": text}
    record = {"run_id": run, "state": "COMMITTED", "output": output, "output_sha256": sha(text.encode()), "region": region, "region_sha256": region_sha256, "finalized_at": at, "files": {n: sha(t.encode()) for n, t in files.items()}} | changes
    (folder / run).mkdir(parents=True)
    for name, data in {**files, "acceptance.json": json.dumps(record)}.items():
        (folder / run / name).write_text(data, encoding="utf-8", newline="")


def entries(spark, rows=()):
    return spark.createDataFrame([(r, "v/old.md", "x", None, None, "2020") for r in rows], "run_id string, output string, output_sha256 string, region string, region_sha256 string, finalized_at string")


def test_damage_is_named_and_a_second_run_changes_nothing(spark, tmp_path):
    folder, index = tmp_path / "research", f"file://{tmp_path}/index"
    for k in range(4):
        seal(folder, f"run-{k}", text=f"text {k} é\r\n", at=f"2024-01-0{k + 1}")
    states = lambda: B.bundle_states(B.bundle_files(spark, f"file://{folder}"))
    legacy, runs = entries(spark, ["run-1", "old-1", "old-2", "../bad"]), entries(spark, ["old-1", "../bad"])
    assert B.bundle_issues(states()).collect() == []
    assert B.rebuild_index(states(), legacy, runs, index) == {"ok": True, "version": 1, "changed": True}
    assert {r.run_id for r in B.current_index(spark, index).collect()} == {"run-0", "run-1", "run-2", "run-3", "old-1"}
    assert B.rebuild_index(states(), legacy, runs, index) == {"ok": True, "version": 1, "changed": False}
    seal(folder, "run-4")
    assert B.rebuild_index(states(), legacy, runs, index)["version"] == 2 and B.current_index(spark, index).count() == 6
    (folder / "run-2" / "claims.jsonl").write_bytes(b"\x00\xff")
    (folder / "run-3" / "facts.jsonl").unlink()
    (folder / "run-1" / "acceptance.json").write_text("no json")
    seal(folder, ".pending-run-9")
    seal(folder, "run-5", state="DRAFT_READY")
    seal(folder, "run-6", files={})
    found = {(r.kind, r.bundle, r.detail) for r in B.bundle_issues(states()).collect()}
    drift = "PROVENANCE_ARCHIVE_DRIFT"
    assert found == {(drift, "run-2", "artifact checksum mismatch: claims.jsonl"), (drift, "run-3", "artifact checksum mismatch: facts.jsonl"), (drift, "run-1", "uncommitted or misidentified archive"), ("PROVENANCE_PENDING", ".pending-run-9", None), (drift, "run-5", "uncommitted or misidentified archive"), (drift, "run-6", "missing archive manifest")}
    assert B.rebuild_index(states(), legacy, runs, index) == {"ok": False, "issues": 6} and B.current_index(spark, index).count() == 6


def test_audit_of_outputs_and_regions(spark, tmp_path):
    note = "head\n<!-- KOS:managed:part:start -->inside<!-- KOS:managed:part:end -->\ntail"
    seal(tmp_path, "whole", "v/a.md", "whole text", at="1")
    seal(tmp_path, "drift", "v/b.md", "old text", at="1")
    seal(tmp_path, "lost", "v/gone.md", "x", at="1")
    seal(tmp_path, "first", "v/c.md", "whole before", at="1")
    seal(tmp_path, "part", "v/c.md", "x", "part", sha(b"inside"), at="2")
    seal(tmp_path, "torn", "v/d.md", "x", "part", sha(b"inside"), at="1")
    seal(tmp_path, "edited", "v/e.md", "x", "part", sha(b"before"), at="1")
    outputs = spark.createDataFrame([("v/a.md", "whole text"), ("v/b.md", "new text"), ("v/c.md", note), ("v/d.md", "no region"), ("v/e.md", note)], "output string, text string")
    records = B.verified(B.bundle_states(B.bundle_files(spark, f"file://{tmp_path}")))
    missing, drift = "FINALIZATION_OUTPUT_MISSING_OR_INVALID", "FINALIZATION_HASH_DRIFT"
    assert {(r.run, r.kind) for r in B.archive_audit(records, outputs).collect()} == {("drift", drift), ("lost", missing), ("torn", missing), ("edited", drift)}
