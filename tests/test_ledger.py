"""Claim ledgers: canonical records, exports that are current, and what makes them stale or drifted."""

import hashlib
import json

from vellumspark.operators import ledger as L

CLAIMS = {
    "run-1": ['{"claim_id": "C-2", "durable": true, "n": 1.0, "t": "é\\n"}', '{"durable": false, "claim_id": "C-1"}', '{"claim_id": "C-3", "durable": true, "deep": {"b": [1e5, null], "a": "x"}}'],
    "run-2": ['{"claim_id": "C-1", "durable": "true"}'],
    "run-3": ['{"claim_id": "C-1", "durable": true}', "no json"],
    "run-4": ['{"claim_id": "C-1", "durable": true}'],
}
plain = lambda rows: "\n".join(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows)
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def claims(spark):
    return spark.createDataFrame([(run, k, c) for run, rows in CLAIMS.items() for k, c in enumerate(rows, 1)], "run_id string, line_no long, record string")


def exported(spark):
    found = {}
    for r in L.export_ledgers(claims(spark)).orderBy("run_id", "line_no").collect():
        found.setdefault(r.run_id, []).append(r.line)
    return found


def test_export(spark):
    found = exported(spark)
    assert set(found) == {"run-1", "run-4"}
    records = [json.loads(c) for c in CLAIMS["run-1"]]
    durable = [records[0], records[2]]
    by_id = sorted(records, key=lambda r: r["claim_id"])
    assert found["run-1"][:5] == ["schema_version: 1", "generated_from_run: run-1", f"durable_claims_sha256: {sha(plain(durable))}", f"claims_source_sha256: {sha(plain(by_id))}", "claims:"]
    assert [json.loads(line[4:]) for line in found["run-1"][5:]] == durable


def test_issues(spark):
    one, four = exported(spark)["run-1"], exported(spark)["run-4"]
    ledgers = {
        "v/ok/claims.yaml": one,
        "claims.yaml": four,
        "v/spaced/claims.yaml": [*four[:1], "", 'generated_from_run:  "run-4"', *four[2:5], '  - { "durable": true,   "claim_id": "C-1" }  '],
        "v/no-run/claims.yaml": four[:1] + four[2:],
        "v/empty-run/claims.yaml": ["generated_from_run:", *four[2:]],
        "v/unsafe/claims.yaml": ["generated_from_run: ../run-4", *four[2:]],
        "v/lost/claims.yaml": ["generated_from_run: run-9", *four[2:]],
        "v/open/claims.yaml": ["generated_from_run: run-3", *four[2:]],
        "v/older/claims.yaml": four,
        "v/no-digest/claims.yaml": four[:2] + four[3:],
        "v/edited/claims.yaml": [line.replace("C-3", "C-4") for line in one],
        "v/short/claims.yaml": one[:-1],
        "v/torn/claims.yaml": [*one, "  - {broken"],
        "v/none/claims.yaml": ["generated_from_run: run-2", f"durable_claims_sha256: {sha('')}"],
    }
    lines = spark.createDataFrame([(p, k, line) for p, rows in ledgers.items() for k, line in enumerate(rows, 1)], "ledger string, line_no long, line string")
    runs = spark.createDataFrame([("run-1", "COMMITTED"), ("run-2", "COMMITTED"), ("run-3", "WRITE_ALLOWED"), ("run-4", "COMMITTED"), ("../run-4", "COMMITTED")], "run_id string, state string")
    entries = spark.createDataFrame([("run-4", "v/older/solution-space.md", "1"), ("run-5", "v/older/solution-space.md", "2"), ("run-6", "v/ok/other.md", "9"), ("run-1", "v/ok/solution-space.md", "1")], "run_id string, output string, finalized_at string")
    got = {(r.ledger.split("/")[-2], r.kind, r.run, r.active_run) for r in L.ledger_issues(lines, runs, claims(spark), entries).collect()}
    stale, drift = "CLAIM_LEDGER_STALE", "CLAIM_LEDGER_DRIFT"
    assert got == {("no-run", stale, None, None), ("empty-run", stale, None, None), ("older", stale, "run-4", "run-5"), *((n, drift, None, None) for n in ("unsafe", "lost", "open", "no-digest", "edited", "short", "torn"))}
