"""Research runs: a linear state machine with a hash-chained journal and frozen digests.

A run's files are small and belong to the driver; what they say about facts,
claims and mechanisms is checked by the constraint queries in ``rules``.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path

from vellumspark.functions.markdown import canonical_line
from vellumspark.operators.provenance import atomic_json, safe_id

# The states in order, and what to do in each.
STATES = (
    "INIT", "EVIDENCE_READY", "FACTS_READY", "FACTS_VERIFIED", "FACTS_FROZEN", "CLAIMS_VERIFIED",
    "MECHANISMS_VERIFIED", "WRITE_ALLOWED", "DRAFT_READY", "FINAL_VERIFIED", "COMMITTED",
)
ROLLBACK = "FACTS_READY"
REVOCABLE = ("WRITE_ALLOWED", "DRAFT_READY", "FINAL_VERIFIED")
ARTIFACTS = {
    "manifest": "evidence-manifest.json", "plan": "coverage-plan.json", "facts": "facts.jsonl", "facts_verify": "facts.verify.jsonl", "claims": "claims.jsonl",
    "claims_verify": "claims.verify.jsonl", "mechanisms": "mechanisms.jsonl", "mechanisms_verify": "mechanisms.verify.jsonl", "draft": "draft.md", "draft_verify": "draft.verify.json",
}
NEXT_STEP = {
    "INIT": "write the evidence manifest and the coverage plan, then verify",
    "EVIDENCE_READY": "confirm the coverage plan, then verify",
    "FACTS_READY": "extract facts that satisfy the plan and have them verified, then verify",
    "FACTS_VERIFIED": "verify freezes the facts",
    "FACTS_FROZEN": "write claims on fact ids only and have them verified, then verify",
    "CLAIMS_VERIFIED": "write mechanisms and have them verified, then verify",
    "MECHANISMS_VERIFIED": "verify runs the last gate check and allows writing",
    "WRITE_ALLOWED": "write the draft from verified artifacts only, then verify the draft",
    "DRAFT_READY": "verify the draft for good",
    "FINAL_VERIFIED": "finalize writes the target note",
    "COMMITTED": "the run is committed",
}


def next_step(state: str) -> str:
    return NEXT_STEP.get(state, "unknown state")


def may_follow(before: str | None, after: str) -> bool:
    """The next state, or the one rollback from a later state."""
    if after not in STATES:
        return False
    if before is None:
        return after == STATES[0]
    a, b = STATES.index(before), STATES.index(after)
    return b == a + 1 or (after == ROLLBACK and a > b)


def entry_digest(entry: dict) -> str:
    return hashlib.sha256(canonical_line({k: v for k, v in entry.items() if k != "entry_sha256"}).encode()).hexdigest()


def records_digest(records: list[dict], key: str) -> str:
    """Digest of records whatever their order."""
    lines = sorted((str(r.get(key, "")), canonical_line(r)) for r in records)
    return hashlib.sha256("\n".join(line for _, line in lines).encode()).hexdigest()


def ordered_digest(records: list[dict]) -> str:
    """Digest of records in their order."""
    return hashlib.sha256("\n".join(map(canonical_line, records)).encode()).hexdigest()


def check_journal(entries: list[dict], state: str | None = None) -> list[str]:
    """Faults of a journal: chain, digests, states, transitions, the run's own state."""
    faults, before, last = [], "", None
    for k, entry in enumerate(entries):
        if not isinstance(entry, dict):
            faults.append("STATE_HISTORY_INVALID_JSON")
            continue
        if entry.get("seq") != k or entry.get("previous_sha256") != before:
            faults.append("STATE_HISTORY_CHAIN_INVALID")
        if entry.get("entry_sha256") != entry_digest(entry):
            faults.append("STATE_HISTORY_HASH_INVALID")
        if entry.get("state") not in STATES:
            faults.append("STATE_HISTORY_UNKNOWN_STATE")
        elif not may_follow(last, entry["state"]):
            faults.append("STATE_TRANSITION_INVALID")
        before, last = entry.get("entry_sha256", ""), entry.get("state") if entry.get("state") in STATES else last
    if state is not None and (not entries or last != state):
        faults.append("STATE_HISTORY_STATE_MISMATCH")
    return faults


@dataclass
class Run:
    """The files of one run under ``root``."""

    root: Path
    run_id: str

    def __post_init__(self):
        self.run_id, self.root = safe_id(self.run_id), Path(self.root)

    @property
    def folder(self) -> Path:
        return self.root / self.run_id

    def path(self, artifact: str) -> Path:
        return self.folder / ARTIFACTS[artifact]

    def exists(self) -> bool:
        return (self.folder / "run.json").is_file()

    def data(self) -> dict:
        return json.loads((self.folder / "run.json").read_text(encoding="utf-8"))

    def state(self) -> str:
        return self.data()["state"]

    def journal(self) -> list[dict]:
        path, out = self.folder / "journal.jsonl", []
        for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
            try:
                out.append(json.loads(line))
            except ValueError:
                out.append(None)
        return out

    def start(self, **about) -> dict:
        if self.exists():
            raise FileExistsError(f"run {self.run_id} exists")
        self.folder.mkdir(parents=True, exist_ok=True)
        return self._save({"run_id": self.run_id, "hashes": {}, **about}, STATES[0])

    def _save(self, data: dict, state: str) -> dict:
        entries = self.journal()
        entry = {"seq": len(entries), "state": state, "previous_sha256": entries[-1]["entry_sha256"] if entries else ""}
        entry["entry_sha256"] = entry_digest(entry)
        with open(self.folder / "journal.jsonl", "a", encoding="utf-8") as log:
            log.write(canonical_line(entry) + "\n")
            log.flush()
            os.fsync(log.fileno())
        data["state"] = state
        atomic_json(self.folder / "run.json", data)
        return data

    def advance(self, state: str, **hashes: str) -> dict:
        """Moves on after the journal has been found sound; digests are kept."""
        data = self.data()
        faults = check_journal(self.journal(), data["state"])
        if faults:
            raise ValueError(f"journal: {', '.join(sorted(set(faults)))}")
        if not may_follow(data["state"], state):
            raise ValueError(f"STATE_TRANSITION_INVALID: {data['state']} to {state}")
        data["hashes"] = {**data["hashes"], **hashes}
        return self._save(data, state)

    def digests(self) -> dict[str, str]:
        """Digests of the artifacts that are there; records in any order."""
        out = {}
        for name in ARTIFACTS:
            path = self.path(name)
            if path.exists():
                raw = path.read_bytes()
                if path.suffix == ".jsonl":
                    raw = "\n".join(sorted(canonical_line(json.loads(x)) for x in raw.decode().splitlines() if x.strip())).encode()
                out[name] = hashlib.sha256(raw).hexdigest()
        return out

    def stale(self) -> list[str]:
        """Artifacts whose digest is another than the one kept."""
        now = self.digests()
        return sorted(k for k, v in self.data()["hashes"].items() if k in ARTIFACTS and now.get(k) != v)

    def invalidate(self) -> list[str]:
        """Revokes the gate of a run whose artifacts changed; from a state that
        allows writing it goes back to ``FACTS_READY``."""
        changed, data = self.stale(), self.data()
        if changed and STATES.index(data["state"]) > STATES.index("FACTS_VERIFIED"):
            data["write_allowed"] = False
            if data["state"] in REVOCABLE:
                self._save(data, ROLLBACK)
            else:
                atomic_json(self.folder / "run.json", data)
        return changed

    def status(self) -> dict:
        data = self.data()
        return {"run_id": self.run_id, "state": data["state"], "next": next_step(data["state"]), "stale": self.stale(), **{f"has_{k}": self.path(k).exists() for k in ARTIFACTS}}
