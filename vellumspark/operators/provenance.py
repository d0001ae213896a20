"""Durable provenance: target bindings, locks, atomic writes, accepted bundles.

Files are written by the driver alone; audits over many bundles run in Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.markdown import parse_note, region_span, without_markers


def safe_id(value: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,119}", value) or ".." in value:
        raise ValueError("not a safe identifier")
    return value


def digest(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def atomic_write(path: Path, data: bytes) -> None:
    """All or nothing: a synced temporary file takes the place, with the old mode."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, path.stat().st_mode & 0o777 if path.exists() else 0o644)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def atomic_json(path: Path, value) -> None:
    atomic_write(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def target_path(root: Path, relative: str) -> Path:
    """A Markdown file inside ``root``: no absolute path, no way up, no symlink."""
    root = Path(root).resolve()
    if relative.startswith("/") or ".." in Path(relative).parts or not relative.endswith(".md"):
        raise ValueError("target must be a Markdown file inside the vault")
    path = root / relative
    at = path
    while at != root:
        if at.is_symlink():
            raise ValueError("target must not pass a symlink")
        at = at.parent
    return path


@contextmanager
def target_lock(root: Path, relative: str):
    """A lock file that only one writer can make."""
    lock = Path(root) / ".locks" / (digest(relative)[:24] + ".lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as error:
        raise RuntimeError("TARGET_LOCKED") from error
    try:
        os.close(handle)
        yield
    finally:
        lock.unlink()


def ownership(text: str) -> str:
    note = parse_note(text)
    owner = (note.properties.get("origin") or ["human"])[0]
    return owner if note.error is None and owner in {"human", "codex", "mixed"} else "human"


def bind_target(root: Path, relative: str, region: str | None = None) -> dict:
    """What a run may write: a new or ``codex`` note whole, a ``mixed`` one in a region."""
    path = target_path(root, relative)
    text = path.read_text(encoding="utf-8") if path.exists() else None
    owner = ownership(text) if text is not None else "codex"
    if owner == "human":
        raise PermissionError("a human note can't be a target")
    if owner == "mixed" and not region:
        raise PermissionError("a mixed note needs a region")
    if region:
        region_span(text or "", safe_id(region))
    return {"target": relative, "base_sha256": digest(text) if text is not None else None, "owner": owner, "region": region}


def check_binding(root: Path, binding: dict | None, relative: str) -> list[str]:
    if not binding:
        return ["TARGET_NOT_BOUND"]
    if binding["target"] != relative:
        return ["TARGET_MISMATCH"]
    path = target_path(root, relative)
    text = path.read_text(encoding="utf-8") if path.exists() else None
    faults = []
    if (digest(text) if text is not None else None) != binding["base_sha256"]:
        faults.append("STALE_TARGET")
    if (ownership(text) if text is not None else "codex") != binding["owner"]:
        faults.append("OWNERSHIP_CHANGED")
    return faults


def final_text(binding: dict, existing: str | None, draft: str) -> str:
    """The note as it will stand: the draft without its markers, whole or in its region."""
    clean = without_markers(draft).strip() + "\n"
    if binding.get("region"):
        start, end = region_span(existing or "", binding["region"])
        return (existing or "")[:start] + "\n" + clean + (existing or "")[end:]
    if ownership(clean) != "codex":
        raise PermissionError("a whole draft must say origin: codex")
    return clean


def write_target(root: Path, binding: dict, draft: str) -> str:
    """Writes the target under its lock, checked again inside; gives its digest."""
    relative = binding["target"]
    with target_lock(root, relative):
        faults = check_binding(root, binding, relative)
        if faults:
            raise RuntimeError(", ".join(faults))
        path = target_path(root, relative)
        text = final_text(binding, path.read_text(encoding="utf-8") if path.exists() else None, draft)
        atomic_write(path, text.encode())
        return digest(text)


def seal_bundle(archive: Path, run_id: str, files: dict[str, bytes], entry: dict) -> Path:
    """Stages a bundle of files with a manifest of their digests, then renames it into place."""
    final, staged = Path(archive) / safe_id(run_id), Path(archive) / f".pending-{safe_id(run_id)}"
    if final.exists():
        raise FileExistsError(f"bundle {run_id} exists")
    staged.mkdir(parents=True)
    for name, data in files.items():
        atomic_write(staged / name, data)
    atomic_json(staged / "acceptance.json", {**entry, "run_id": run_id, "files": {n: digest(d) for n, d in sorted(files.items())}})
    os.replace(staged, final)
    return final


def audit_bundles(spark: SparkSession, archive: str) -> DataFrame:
    """(run_id, name, problem): files of bundles that are missing, unexpected or changed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archive)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("digest"), "content")
    kind = "run_id string, files map<string,string>"
    accepted = named.where("name = 'acceptance.json'").select("run_id", F.from_json(F.col("content").cast("string"), kind).alias("a"))
    stored = accepted.select("run_id", F.explode("a.files").alias("name", "stored"))
    both = stored.join(named.where("name <> 'acceptance.json'").select("run_id", "name", "digest"), ["run_id", "name"], "full_outer")
    pending = F.when(F.col("run_id").startswith(".pending-"), "PROVENANCE_PENDING")
    problem = pending.when(F.col("stored").isNull(), "unexpected file").when(F.col("digest").isNull(), "missing file").when(F.col("stored") != F.col("digest"), "PROVENANCE_ARCHIVE_DRIFT")
    return both.select("run_id", "name", problem.alias("problem")).where("problem is not null")


def provenance_for(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """Acceptances of the asked outputs, the newest first."""
    return entries.join(outputs.select("output").distinct(), "output", "left_semi").orderBy(F.desc("finalized_at"), F.desc("run_id"))
