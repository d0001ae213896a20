import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vellumspark.functions.text import han_tokens, safe_id, stated_counts, tokens, universal_wording
from vellumspark.operators import graph, lexical, provenance, rules, runs, vectors
from vellumspark.sources import vector_store
from vellumspark.streaming import events


def test_state_machine(tmp_path):
    run = runs.Run(tmp_path, "r1")
    run.start(project="p")
    with pytest.raises(ValueError):
        run.advance("FACTS_READY")
    run.advance("EVIDENCE_READY")
    run.path("facts").write_text('{"b":1}\n{"a":2}\n')
    for state in runs.STATES[2:8]:
        run.advance(state, **({"facts": run.digests()["facts"]} if state == "FACTS_FROZEN" else {}))
    assert run.state() == "WRITE_ALLOWED" and run.stale() == [] and runs.check_journal(run.journal(), "WRITE_ALLOWED") == []
    run.path("facts").write_text('{"a":2}\n{"b":1}\n')
    assert run.stale() == []  # the order of records does not count
    run.path("facts").write_text('{"a":3}\n')
    assert run.invalidate() == ["facts"] and run.state() == "FACTS_READY" and run.data()["write_allowed"] is False
    log = tmp_path / "r1" / "journal.jsonl"
    log.write_text(log.read_text().replace("FACTS_FROZEN", "COMMITTED"))
    faults = runs.check_journal(run.journal(), "FACTS_READY")
    assert "STATE_HISTORY_HASH_INVALID" in faults and "STATE_TRANSITION_INVALID" in faults
    with pytest.raises(ValueError):
        run.advance("FACTS_VERIFIED")
    assert run.status()["has_facts"] and runs.next_step("?") == "unknown state"


def test_digests():
    a, b = {"id": "1", "x": 1}, {"id": "2"}
    assert runs.records_digest([a, b], "id") == runs.records_digest([b, a], "id")
    assert runs.ordered_digest([a, b]) != runs.ordered_digest([b, a])


def test_targets(tmp_path):
    mixed = "---\norigin: mixed\n---\nmine\n<!-- KOS:managed:r:start -->old<!-- KOS:managed:r:end -->\nmine too\n"
    (tmp_path / "m.md").write_text(mixed)
    (tmp_path / "h.md").write_text("human\n")
    for relative, region in (("h.md", None), ("m.md", None), ("../x.md", None), ("/x.md", None), ("x.txt", None), ("m.md", "q")):
        with pytest.raises((PermissionError, ValueError)):
            provenance.bind_target(tmp_path, relative, region)
    binding = provenance.bind_target(tmp_path, "m.md", "r")
    done = provenance.write_target(tmp_path, binding, "new <!-- KOS:refs=a -->text")
    text = (tmp_path / "m.md").read_text()
    assert "new text" in text and text.startswith("---\norigin: mixed\n---\nmine\n") and text.endswith("\nmine too\n") and done == provenance.digest(text)
    assert provenance.check_binding(tmp_path, binding, "m.md") == ["STALE_TARGET"]
    assert provenance.check_binding(tmp_path, None, "m.md") == ["TARGET_NOT_BOUND"] and provenance.check_binding(tmp_path, binding, "n.md") == ["TARGET_MISMATCH"]
    with provenance.target_lock(tmp_path, "m.md"), pytest.raises(RuntimeError):
        provenance.write_target(tmp_path, binding, "x")


def test_bundles(spark, tmp_path):
    provenance.seal_bundle(tmp_path, "r1", {"facts.jsonl": b"{}", "draft.md": b"x"}, {"output": "n.md"})
    provenance.seal_bundle(tmp_path, "r2", {"facts.jsonl": b"{}"}, {"output": "n.md"})
    assert provenance.audit_bundles(spark, str(tmp_path)).count() == 0
    (tmp_path / "r1" / "draft.md").write_bytes(b"y")
    (tmp_path / "r2" / "facts.jsonl").unlink()
    (tmp_path / "r2" / "more.txt").write_text("z")
    got = {(r.run_id, r.name): r.problem for r in provenance.audit_bundles(spark, str(tmp_path)).collect()}
    assert got == {("r1", "draft.md"): "PROVENANCE_ARCHIVE_DRIFT", ("r2", "facts.jsonl"): "missing file", ("r2", "more.txt"): "unexpected file"}
    with pytest.raises(FileExistsError):
        provenance.seal_bundle(tmp_path, "r1", {}, {})


def test_text_functions(spark):
    row = spark.sql("select 'Möchte x_1 图神经 网' as t, 'Both teams, Five methods and 12 solutions' as u, '两者皆可' as v, 'small' as w, 'a..b' as i")
    got = row.select(tokens("t").alias("t"), han_tokens("t").alias("h"), stated_counts("u").alias("c"), universal_wording("u").alias("u"), universal_wording("v").alias("v"), universal_wording("w").alias("w"), safe_id("i").alias("i")).first()
    assert got.t == ["m", "chte", "x_1", "图", "神", "经", "图神", "神经", "网"] and got.h == got.t[3:]
    assert got.c == [5, 12] and got.u and got.v and not got.w and not got.i


def test_bm25_guards_and_plan(spark):
    docs = spark.createDataFrame([("a", "one two two"), ("b", "three"), ("c", "")], "id string, text string")
    assert lexical.bm25(docs, [], 5).count() == 0 and lexical.bm25(docs, ["one"], 0).count() == 0
    hits = lexical.bm25(docs, ["one", "two"], 5)
    assert [r.id for r in hits.collect()] == ["a"]
    plan = hits._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    alone = lexical.bm25(docs, ["zzz"], 5, phrase="THREE").collect()
    assert [(r.id, r.score) for r in alone] == [("b", 2.5)]  # the phrase alone makes a hit


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 9)], "id string, rank long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank long")
    one, two = ({r.id: r.score for r in vectors.fuse(p, q, 10, id_col="id").collect()} for p, q in ((a, b), (b, a)))
    assert one == two and one["y"] == round(1 / 61 + 1 / 62, 6) and one["x"] == round(1 / 61, 6)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "source long, target long")
    assert sorted(r.id for r in graph.on_cycle(edges).collect()) == [1, 2, 3]
    direct = spark.createDataFrame([(4,)], "id long")
    assert sorted(r.id for r in graph.transitive_impact(edges, direct).collect()) == [1, 2, 3]


def test_supersession(spark):
    rows = [("a", "n", None, "1"), ("b", "n", "r", "2"), ("c", "n", "s", "3"), ("d", "m", "r", "1"), ("e", "m", None, "2"), ("f", "k", "r", "1"), ("g", "k", "r", "1")]
    got = rules.active_acceptances(spark.createDataFrame(rows, "run_id string, output string, region string, finalized_at string"))
    assert sorted(r.run_id for r in got.collect()) == ["b", "c", "e", "g"]


def test_dataset_digest_ignores_order(spark):
    rows = spark.range(50).withColumn("x", F.concat(F.lit("v"), F.col("id")))
    one, two = (rules.dataset_digest(r, F.col("x")).first()[0] for r in (rows, rows.orderBy(F.desc("id")).repartition(3)))
    assert one == two


def test_vector_index(spark, tmp_path):
    chunks = spark.createDataFrame([(str(k), f"t{k}", f"h{k}") for k in range(70)], "chunk_id string, text string, content_hash string")
    make = lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts]
    path = str(tmp_path / "i")
    built = vector_store.build_index(chunks, make, path, provider="stub", model="m", dimension=2)
    assert built["status"] == "built" and built["dimension"] == 2 and built["chunks"] == 70
    found, why = vector_store.read_index(chunks, path, provider="stub", model="m")
    assert why == "" and found.count() == 70
    assert vector_store.read_index(chunks, path, provider="stub", model="n")[1] == "changed settings"
    assert vector_store.read_index(chunks.withColumn("content_hash", F.lit("x")), path, provider="stub", model="m")[1] == "stale corpus"
    assert vector_store.build_index(chunks.limit(0), make, path, provider="stub", model="m") == {"status": "empty"}
    assert vector_store.read_index(chunks, path, provider="stub", model="m")[1] == "missing"
    assert vector_store.build_index(chunks, lambda t: [[0.0]] * len(t), path, provider="stub", model="m")["status"] == "unavailable"


def test_streams(spark, tmp_path):
    source = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) as ts, id % 2 as k, 1.0D as value from range(50)")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read_stream(spark, str(tmp_path / "in"), source.schema), "6 hours", "k")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, events.tumbling(source, "6 hours", "k").collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want

    chain, before = [], {}
    for k in range(12):
        run, entry = k % 2, hashlib.sha256(str(k).encode()).hexdigest()
        chain.append((run, k // 2, before.get(run, "") if k != 7 else "edited", entry))
        before[run] = entry
    spark.createDataFrame(chain, "run long, seq long, previous string, entry string").coalesce(1).write.parquet(str(tmp_path / "j"))
    live = events.journal_stream(spark.readStream.schema("run long, seq long, previous string, entry string").parquet(str(tmp_path / "j")))
    live.writeStream.format("memory").queryName("bad").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("bad").collect()] == [(1, 3)]


def test_atomic_json(tmp_path):
    provenance.atomic_json(tmp_path / "a" / "x.json", {"b": "é"})
    assert json.loads((tmp_path / "a" / "x.json").read_text()) == {"b": "é"} and [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]
