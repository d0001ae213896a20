"""Mixing sources to target weights by soft domain membership.

A Gaussian naive Bayes classifier, fitted on the labelled documents, predicts
for every document the chance of each domain (quality 0/1 and toxic 0/1).
Nonnegative rates r are then fitted by projected-gradient least squares so that
the expected tokens of each domain, the sum of r * tokens * chance, meet the
targets.  The gradient is taken in the metric of the documents' tokens, each
domain's residual is weighted by its own expected tokens, and the projection
clips rates at zero.  Steps are implicit: each takes the gradient at its own
end, so it may be ``STEP`` long where domains are hard to tell apart.  Its four
numbers are found by Newton's method; every try is one aggregation of a few
numbers.  The fit ends when the targets are met or no rates come nearer to
them, and fails if it reaches neither.

Everything is DataFrame expressions: no Python runs on the executors, and the
driver gets one row of sums per step.

Defined cases: null text has no tokens, and its rate follows its chances like
any other; without labelled documents all chances are equal; a domain without
labelled documents has chance 0, and its target is dealt to the others; labels
other than 0 count as 1, null ones are left out, of several the largest holds;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
#: Shares of the mixture's tokens, and its tokens as a share of the input's.
TARGETS = {"q0t0": 0.05, "q0t1": 0.0, "q1t0": 0.9, "q1t1": 0.05}
EPOCHS = 0.9
#: Largest residual of a fit that meets its targets, as a share of all tokens; if they are out
#: of reach, how much of all tokens the weighted squares may still exceed the least ones by.
TOLERANCE, SLACK = 1e-6, 1e-7
#: Length of the first implicit step, how much longer each next one is, and the longest.  A fit
#: that isn't done after ``STEPS`` aggregations fails.
STEP, LONGER, LONGEST, STEPS = 1e6, 30, 1e11, 400
#: Least standard deviation of a feature.
SPREAD = 0.02

_SPACE = "[\\x20\\x09-\\x0D]+"


def features(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, n_tokens, f0...f6) of every document; extra columns only as asked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.length(text)
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    base = docs.select(F.col(id_col).alias("id"), *keep, text.alias("text"), length.alias("chars"), words.alias("words"))
    text, length, n = F.col("text"), F.col("chars"), F.size("words")
    several = F.greatest(n, F.lit(1))
    whole = F.greatest(length, F.lit(1))

    def times(char: str):
        return (length - F.length(F.replace(text, F.lit(char), F.lit("")))) / whole

    found = [
        F.regexp_count(text, F.lit("[!?$#*%&@^~+=<>{}_/;:\\[\\]]")) / whole,
        F.regexp_count(text, F.lit("[0-9]")) / whole,
        times("|"),
        times("\n"),
        F.size(F.array_distinct("words")) / several,
        F.log1p(length / several) / 4,
        F.octet_length(text) / whole - 1,
    ]
    return base.select("id", *keep, n.cast("long").alias("n_tokens"), *(x.cast("double").alias(f"f{k}") for k, x in enumerate(found)))


def _chances(rows: DataFrame, labels: DataFrame, id_col: str) -> tuple[list[Column], list[bool]]:
    """An expression for each domain's posterior, and which domains have labels."""
    flag = lambda c: F.max((F.col(c) != 0).cast("int"))
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("q"), flag("toxic").alias("t"))
    names = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    sums = [F.count("*").alias("n")] + [s for c in names for s in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    domain = F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("t"), F.col("t").cast("string"))
    fitted = {r["d"]: r for r in rows.join(known, "id").groupBy(domain.alias("d")).agg(*sums).collect()}  # at most four rows
    total = sum(r["n"] for r in fitted.values())
    if not total:
        return [F.lit(1.0 / len(DOMAINS))] * len(DOMAINS), [True] * len(DOMAINS)
    scores = []
    for d in DOMAINS:
        if d not in fitted:
            scores.append(None)
            continue
        r = fitted[d]
        score = F.lit(math.log(r["n"] / total))
        for c in names:
            variance = r[f"v_{c}"] + SPREAD**2
            score = score - F.pow(F.col(c) - F.lit(r[f"m_{c}"]), 2) / F.lit(2 * variance) - F.lit(0.5 * math.log(variance))
        scores.append(score)
    top = F.greatest(F.lit(-1e300), *(s for s in scores if s is not None)) if sum(s is not None for s in scores) > 0 else F.lit(0.0)
    weights = [F.lit(0.0) if s is None else F.exp(s - top) for s in scores]
    whole = sum(weights[1:], weights[0])
    return [F.round(w / whole, 6) for w in weights], [s is not None for s in scores]


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps so far: from 1, each moves along the chances and clips at 0."""
    rate = F.lit(1.0)
    if history:
        steps = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in history))
        chances = [F.col(f"p_{d}") for d in DOMAINS]
        rate = F.aggregate(steps, rate, lambda r, g: F.greatest(F.lit(0.0), r - sum((g[k] * p for k, p in enumerate(chances)), F.lit(0.0))))
    return rate


def _fit(rows: DataFrame, mass: np.ndarray, goal: np.ndarray, total: float) -> list[list[float]]:
    """Steps after which the rates meet the goal, or are as near to it as rates can be."""
    tokens, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(j, k) for j in range(len(p)) for k in range(j, len(p))]
    there = mass > 0
    weight = np.where(there, 1 / np.maximum(mass, 1e-9), 0.0)
    tries, length = 0, STEP

    def sums(frame: DataFrame, *columns: Column) -> np.ndarray:
        nonlocal tries
        tries += 1
        if tries > STEPS:
            raise RuntimeError(f"mixing rates not fitted after {STEPS} aggregations; the residuals are {((now - goal) / total).tolist()} of all tokens")
        return np.array([float(x or 0.0) for x in frame.agg(*columns).first()])

    def at(step: np.ndarray):
        """Value, gradient and curvature of what the implicit step minimises, and the domains' tokens after it."""
        rated = rows.select("n_tokens", *(f"p_{d}" for d in DOMAINS), _rate([*history, step.tolist()]).alias("r"))
        kept = F.when(F.col("r") > 0, tokens).otherwise(0.0)
        got = sums(rated, F.sum(tokens * F.col("r") * F.col("r")).alias("s"), *(F.sum(tokens * x * F.col("r")).alias(f"t{k}") for k, x in enumerate(p)), *(F.sum(kept * p[j] * p[k]).alias(f"h{j}{k}") for j, k in pairs))
        after, curve = got[1 : 1 + len(p)], np.diag(np.where(there, mass / length, 1.0))
        for (j, k), x in zip(pairs, got[1 + len(p) :]):
            curve[j, k] += x
            curve[k, j] = curve[j, k]
        value = 0.5 * got[0] + goal @ step + 0.5 * (mass / length) @ step**2
        return value, np.where(there, goal - after + mass / length * step, 0.0), curve, after

    history: list[list[float]] = []
    now = mass
    while np.abs(now - goal).max() > TOLERANCE * total:
        # By convexity the squares exceed the least ones by no more than the slopes of the rates that
        # could still fall, and the steepest negative slope times the tokens that rates may add.
        slope = weight * (now - goal)
        steepest = sums(rows.where("n_tokens > 0"), F.min(sum((F.lit(float(x)) * y for x, y in zip(slope, p)), F.lit(0.0))).alias("s"))[0]
        if slope @ now + max(0.0, -steepest) * max(goal.sum(), now.sum()) <= SLACK * total:
            break
        step = np.zeros(len(p))
        value, gradient, curve, after = at(step)
        while np.abs(gradient).max() > 0.01 * TOLERANCE * total:
            move, part = -np.linalg.solve(curve, gradient), 1.0
            while (new := at(step + part * move))[0] > value + 1e-4 * part * (gradient @ move) + 1e-13 * abs(value):
                part /= 2
            step = step + part * move
            value, gradient, curve, after = new
        history.append(step.tolist())
        now, length = after, min(LONGER * length, LONGEST)
    return history


def mix_to_targets(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    epochs: float = EPOCHS,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("source",),
) -> DataFrame:
    """(id, those of the kept columns that there are, n_tokens, p_<domain>..., rate, copies) of every document.

    ``copies`` realises the rate in whole copies: its whole part, and one more
    with the chance of the rest, decided by the hash of the id."""
    keep = tuple(c for c in keep if c in docs.columns)
    rows = materialize(features(docs, id_col, text_col, *keep), "mix-features")
    chances, known = _chances(rows, labels, id_col)
    rows = materialize(rows.select("id", *keep, "n_tokens", *(p.alias(f"p_{d}") for d, p in zip(DOMAINS, chances))), "mix-chances")
    tokens, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in DOMAINS]
    first = rows.agg(*(F.sum(tokens * x).alias(f"t{k}") for k, x in enumerate(p)), F.sum(tokens).alias("all")).first()
    total = float(first["all"] or 0.0)
    mass = np.array([float(first[f"t{k}"] or 0.0) for k in range(len(DOMAINS))])
    share = np.array([float(targets.get(d, 0.0)) for d in DOMAINS]) * (np.array(known) & (mass > 0))
    goal = epochs * total * share / share.sum() if share.sum() > 0 else epochs * mass
    history = _fit(rows, mass, goal, total) if total > 0 else []
    rate = F.round(_rate(history), 6)
    luck = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    out = rows.withColumn("rate", rate)
    copies = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    out = out.select("*", copies.alias("copies"))
    return out.select(F.col("id").alias(id_col), *keep, "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")
