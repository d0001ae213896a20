"""Runs driven by events: the stream, the batch and the journal check agree."""

import datetime as dt
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumspark.operators import rules
from vellumspark.operators.runs import STATES
from vellumspark.streaming import events as E
from vellumspark.streaming import runs as R

SCHEMA = "run string, event_id long, at timestamp, kind string, artifact string, digest string"
START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def states(rows):
    """(state, reason) of one run's events by a fold of its own."""
    out, frozen, now, state, last = [("INIT", "created")] if rows else [], {}, {}, "INIT", None
    for at, kind, artifact, digest in rows:
        if state in ("WRITE_ALLOWED", "DRAFT_READY", "FINAL_VERIFIED") and at - last > 24 * HOUR:
            state, frozen = "FACTS_READY", {}
            out.append((state, "gate expired"))
        last = at
        if kind == "artifact":
            now[artifact] = digest
            if any(now.get(a) != d for a, d in frozen.items()) and state != "COMMITTED":
                state, frozen = "FACTS_READY", {}
                out.append((state, f"{artifact} changed"))
        elif kind == "verified" and state != "COMMITTED":
            state = STATES[STATES.index(state) + 1]
            out.append((state, "verified"))
            name = {"FACTS_FROZEN": "facts", "CLAIMS_VERIFIED": "claims", "MECHANISMS_VERIFIED": "mechanisms"}.get(state)
            if name and now.get(name):
                frozen[name] = now[name]
    return out


def made(seed, runs=12, length=40):
    rng, rows = random.Random(seed), []
    for run in range(runs):
        at = START
        for k in range(rng.randrange(1, length)):
            at += rng.choice([0, 1, 2, 5]) * HOUR + (30 * HOUR if rng.random() < 0.06 else dt.timedelta())
            kind = rng.choices(["verified", "failed", "artifact"], [8, 1, 1.2])[0]
            rows.append((f"r{run}", k, at, kind, rng.choice(R.ARTIFACTS), rng.choice("xy")))
    return rows


def by_run(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.run, r.seq)):
        found.setdefault(r.run, []).append((r.state, r.reason))
    return found


def test_batch_against_a_plain_fold(spark):
    rows = made(1, runs=30) + [("empty kind", 1, START, None, None, None), ("other", 1, START, "artifact", "unknown", "x")]
    events = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA)
    got = R.journals(events).cache()
    want = {run: states([r[2:] for r in rows if r[0] == run]) for run in {r[0] for r in rows}}
    want["other"] = [("INIT", "created")]
    assert by_run(got.collect()) == want
    reasons = {reason.split(" ")[-1] for entries in want.values() for _, reason in entries}
    assert reasons == {"created", "verified", "changed", "expired"}
    assert rules.journal_issues(got, list(STATES)).count() == 0
    assert R.journals(events.where("false")).count() == 0


def test_stream_against_the_batch(spark, tmp_path):
    rows = sorted(made(3, runs=6, length=30), key=lambda r: r[2])
    for k in range(0, len(rows), 25):  # one file a trigger, in the order of time
        spark.createDataFrame(rows[k : k + 25], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:05d}")
    last = max(r[2] for r in rows)
    spark.createDataFrame([("clock", 0, last + 60 * HOUR, "failed", None, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/99998")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = R.live_journals(stream).writeStream.format("memory").queryName("journal").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = by_run(spark.table("journal").where("run <> 'clock'").collect())
    # The clock's event lies behind every gate, so that the timers of gates left open have run.
    closing = [(run, 999, last + 50 * HOUR, "failed", None, None) for run in {r[0] for r in rows}]
    want = by_run(R.journals(spark.createDataFrame(rows + closing, SCHEMA)).collect())
    assert got == want
    chain = spark.table("journal").select("run", "seq", "previous", "entry")
    assert rules.journal_issues(spark.table("journal").select("run", "seq", "state", "previous", "entry"), list(STATES)).count() == 0
    chain.coalesce(1).write.parquet(f"{tmp_path}/chain")
    live = E.journal_stream(spark.readStream.schema(chain.schema).parquet(f"{tmp_path}/chain")).writeStream.format("memory").queryName("chain").outputMode("append").option("checkpointLocation", f"{tmp_path}/state2").trigger(availableNow=True).start()
    live.awaitTermination()
    assert spark.table("chain").count() == 0


def test_the_registered_query(spark):
    got = entry.queries()["run_journals"](spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).collect()
    rows = {}
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        kind = "artifact" if r.event_id % 9 == 4 else "failed" if r.event_id % 7 == 3 else "verified"
        rows.setdefault(r.user_id, []).append((r.ts, kind, R.ARTIFACTS[r.event_id % 3], f"d{r.event_id % 2}"))
    assert by_run(got.collect()) == {run: states(x) for run, x in rows.items()}
