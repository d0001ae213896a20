import math

import numpy as np

from vellumspark.llm import near_vectors as N


def brute(rows, threshold=0.9):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    near = [{j for j, y in enumerate(units) if j != i and x is not None and y is not None and (rows[i][1] == rows[j][1] or x @ y >= threshold)} for i, x in enumerate(units)]
    out = []
    for i, (vid, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((vid, len(near[i]), least, vid == least))
    return sorted(out)


def got(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as cell")
    return sorted(tuple(r) for r in N.near_vectors(frame).collect())


def corpus(n=300, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[rng.integers(40)] + 0.12 * rng.normal(size=16)).tolist()) for k in range(n)]
    rows += [(n + k, base[0].tolist()) for k in range(20)] + [(n + 20, (base[0] * 1e200).tolist()), (n + 21, (base[0] * 1e-200).tolist())]
    rows += [(n + 30, None), (n + 31, [0.0] * 16), (n + 32, [float("nan")] + [1.0] * 15), (n + 33, [float("inf")] + [1.0] * 15), (n + 34, [None] + [1.0] * 15), (n + 35, [])]
    return rows


def test_one_cell_is_exact(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    rows = corpus(seed=1)
    assert got(spark, rows) == brute(rows)
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    mine, want = got(spark, rows), brute(rows)
    assert sum(r[1] for r in mine) >= 0.9 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(mine, want))


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(4, None)]) == [(4, 0, 4, True)]


def test_recall_at_default_constants(spark):
    """Above the size from which cells are probed, at least 0.9 of the linked pairs of a brute-force comparison are found."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((3000, 16))
    x = centers[rng.integers(0, 3000, 20_000)] + 0.16 * rng.standard_normal((20_000, 16))
    assert N.cell_count(len(x)) > 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((unit[a : a + 2000] @ unit.T >= 0.9).sum()) for a in range(0, len(x), 2000)) - len(x)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in N.near_vectors(frame).collect())
    assert 0.9 * want <= got <= want


def test_repeated_ids(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0])] * 2 + [(1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(N.near_vectors(frame).collect()) == 3
