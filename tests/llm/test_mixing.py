import numpy as np
import pytest

from vellumspark.llm import mixing as M

GOOD = "Some words of plain prose that go on, with a stop. "
JUNK = "A*** b### c%%% d&&& e$$$ "


def corpus(spark, n=60):
    docs = [(k, (JUNK if k % 4 == 0 else GOOD) * (1 + k % 7), f"s{k % 3}", k) for k in range(n)] + [(n, None, "s0", 0), (n + 1, "", None, 0), (n + 2, "word " * 50_000, "s1", 0)]
    labels = [(k, int(k % 4 != 0), 0) for k in range(0, n, 2)] + [(0, 0, 0), (2, None, 1), (999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, rate long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_totals_meet_targets(spark):
    docs, labels = corpus(spark)
    got = M.mix_to_targets(docs, labels, {"q1t0": 0.5, "q0t0": 0.5}, 0.8).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    total = got.n_tokens.sum()
    for d, share in (("q1t0", 0.5), ("q0t0", 0.5)):
        assert abs((got.rate * got.n_tokens * got[f"p_{d}"]).sum() - share * 0.8 * total) < 1e-3 * total
    assert (np.floor(got.rate) <= got.copies).all() and (got.copies <= np.ceil(got.rate)).all()
    labelled = got[(got.doc_id < 60)]
    assert ((labelled.p_q0t0 > 0.5) == (labelled.doc_id % 4 == 0)).all()


def test_same_as_dense_projected_gradient(spark):
    docs, labels = corpus(spark)
    got = M.mix_to_targets(docs, labels, {"q1t0": 0.02, "q0t0": 0.98}, 1.5).toPandas()
    p, t = got[[f"p_{d}" for d in M.DOMAINS]].to_numpy(), got.n_tokens.to_numpy(float)
    mass = t @ p
    goal = 1.5 * t.sum() * np.array([0.98, 0, 0.02, 0])
    r = np.ones(len(t))
    for _ in range(M.STEPS):
        residual = (t * r) @ p - goal
        if abs(residual).max() <= M.TOLERANCE * t.sum():
            break
        r = np.maximum(0, r - p @ np.where(mass > 0, residual / np.maximum(mass, 1e-9), 0))
    assert np.allclose(got.rate, r, atol=2e-6)


def test_no_python_on_executors(spark):
    docs, labels = corpus(spark)
    plan = M.mix_to_targets(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("labelled", [False, True])
def test_empty(spark, labelled):
    docs, labels = corpus(spark)
    none = labels.where("false")
    assert M.mix_to_targets(docs.where("false"), labels if labelled else none).count() == 0
    got = M.mix_to_targets(docs, none).toPandas()
    assert len(got) == docs.count() and (got[[f"p_{d}" for d in M.DOMAINS]] == 0.25).all().all()


def test_domains_that_are_hard_to_tell_apart(spark):
    """Forty plain gradient steps leave these targets missed by a tenth of all tokens."""
    rng = np.random.default_rng(3)
    chance = 0.5 + 0.03 * rng.standard_normal(400)
    rows = [(k, 100 + k % 50, 0.1, float(0.45 + c - 0.5), 0.2, float(0.25 - c + 0.5)) for k, c in enumerate(chance)]
    frame = spark.createDataFrame(rows, "id long, n_tokens long, p_q0t0 double, p_q0t1 double, p_q1t0 double, p_q1t1 double")
    p, t = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float)
    mass, total = t @ p, t.sum()

    def after(history):
        r = np.ones(len(t))
        for g in history:
            r = np.maximum(0, r - p @ np.array(g))
        return (t * r) @ p

    def plain(goal, steps):
        r = np.ones(len(t))
        for _ in range(steps):
            r = np.maximum(0, r - p @ (((t * r) @ p - goal) / mass))
        return (t * r) @ p

    # Within reach: the tokens of some rates that are not near 1.
    goal = (t * np.where(chance > 0.53, 5.0, 0.05)) @ p
    assert np.abs(plain(goal, 40) - goal).max() > 0.01 * total
    assert np.abs(after(M._fit(frame, mass, goal, total)) - goal).max() <= M.TOLERANCE * total
    # Out of reach: as near as long plain iteration comes.
    goal = np.array([0.0, 0.9, 0.05, 0.05]) * total
    square = lambda now: (((now - goal) ** 2) / mass).sum() / total
    assert square(after(M._fit(frame, mass, goal, total))) <= square(plain(goal, 20_000)) + 1e-6 < square(plain(goal, 40))
