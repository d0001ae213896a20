"""Strongly connected components of a distributed graph, and a cycle as witness of each.

Three steps alternate until no edge is left.  Nodes without a way in or without a way out go.  Nodes with one of each
are taken out of their chains by pointer doubling, so that a chain or ring of n nodes takes log2 n joins.  What remains is coloured: forward with
the least node that reaches each node, then, inside a colour, backward with the least node that each reaches; where
both agree lies the component of the colour's node.  Every round is written to the shared folder.

The witness follows from each node the least edge inside its component; doubling finds where these walks end in a
cycle and how far each node of it is from the cycle's least node.

Defined cases: an edge from a node to itself is a cycle of one; repeated edges count once, edges with a null end not at
all; an empty graph has no component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.tables import dropped, written


def _replaced(new: DataFrame, name: str, *old: DataFrame) -> DataFrame:
    """``new`` written, and what it was made from deleted."""
    made = written(new, name)
    dropped(*old)
    return made


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``nodes`` (id)."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
    return edges.select("source", "target")


def _ends(edges: DataFrame) -> DataFrame:
    """(id, ins, outs, back, ahead): a node's number of edges each way; the last two are its neighbours where there is one."""
    none = F.lit(None)
    out = edges.select(F.col("source").alias("id"), none.alias("back"), F.col("target").alias("ahead"))
    both = out.unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("back"), none.alias("ahead")))
    return both.groupBy("id").agg(F.count("back").alias("ins"), F.count("ahead").alias("outs"), F.max("back").alias("back"), F.max("ahead").alias("ahead"))


def _chains(inner: DataFrame) -> DataFrame:
    """(id, ahead, far, top, low, open) of nodes with one way in and out, (id, back, ahead): the first node before the chain
    and the chain's own first node; rows on rings stay open, with the ring's least node in ``low``."""
    state = inner.select("id", "ahead", F.col("back").alias("far"), F.col("id").alias("top"), F.col("id").alias("low"), F.lit(True).alias("open"), F.lit(True).alias("moved"))
    state, before = written(state, "chains"), -1
    while True:
        up = state.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("top").alias("top2"), F.col("low").alias("low2"))
        met = state.join(up, "far", "left")
        open_ = F.col("far2").isNotNull()
        jumped = met.select("id", "ahead", F.coalesce("far2", "far").alias("far"), F.coalesce("top2", "top").alias("top"), F.least("low", "low2").alias("low"), open_.alias("open"), (open_ & (F.col("low2") < F.col("low"))).alias("moved"))
        state = _replaced(jumped, "chains", state)
        left, moved = state.where("open").agg(F.count("*"), F.coalesce(F.bool_or("moved"), F.lit(False))).first()
        if not left or (left == before and not moved):
            return state
        before = left


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(id, color): the least node, itself included, that reaches each node.

    A round takes the least colour over the edges in, and then the colour of the own colour's node, which reaches as far again."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    state = written(nodes.select("id", F.col("id").alias("color"), F.lit(True).alias("moved")), "colors")
    while True:
        passed = edges.join(state.select(F.col("id").alias("source"), "color"), "source").groupBy(F.col("target").alias("id")).agg(F.min("color").alias("new"))
        once = state.select("id", "color").join(passed, "id", "left").select("id", F.col("color").alias("old"), F.least("color", "new").alias("color"))
        over = state.select(F.col("id").alias("color"), F.col("color").alias("further"))
        twice = once.join(over, "color", "left").select("id", F.least("color", "further").alias("color"), "old")
        state = _replaced(twice.select("id", "color", (F.col("color") < F.col("old")).alias("moved")), "colors", state)
        if state.where("moved").isEmpty():
            return state.drop("moved")


def _colored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (cycle, id) of the colours' own nodes, and the edges that other components may still lie on."""
    forward = _least_reaching(edges)
    same = edges
    for end in ("source", "target"):
        same = same.join(forward.select(F.col("id").alias(end), F.col("color").alias(f"{end}_color")), end)
    same = written(same.where("source_color = target_color").select("source", "target"), "color-edges")
    backward = _least_reaching(same.select(F.col("target").alias("source"), F.col("source").alias("target")))
    members = written(forward.join(backward.withColumnRenamed("color", "back"), "id").where("color = back").select("id", F.col("color").alias("cycle")), "color-members")
    kept = same.join(members.select(F.col("id").alias("source"), F.col("cycle").alias("a")), "source").join(members.select(F.col("id").alias("target"), F.col("cycle").alias("b")), "target")
    found = written(kept.where("a = b").select(F.col("a").alias("cycle"), F.col("source").alias("id")).distinct(), "components")
    rest = written(_without(same, members), "edges")
    dropped(same, members)
    return found, rest


def strong_components(edges: DataFrame) -> DataFrame:
    """(cycle, id): the nodes of (source, target) edges that lie on a cycle, by component, which its least node names."""
    current = written(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    found: list[DataFrame] = []
    taken_out: list[DataFrame] = []
    while not current.isEmpty():
        ends = written(_ends(current), "ends")
        dead, inner = ends.where("ins = 0 or outs = 0"), ends.where("ins = 1 and outs = 1")
        n_dead, n_inner = ends.agg(F.count_if(F.expr("ins = 0 or outs = 0")), F.count_if(F.expr("ins = 1 and outs = 1"))).first()
        if n_inner:
            state = _chains(inner)
            found.append(written(state.where("open").select(F.col("low").alias("cycle"), "id"), "rings"))
            chains = state.where("not open")
            last = chains.join(inner.select(F.col("id").alias("ahead")), "ahead", "left_anti").select("top", "ahead", "far")
            taken_out.append(written(chains.drop("ahead").join(last.select("top", "ahead"), "top").select("id", F.col("far").alias("back"), "ahead"), "inner"))
            short = last.select(F.col("far").alias("source"), F.col("ahead").alias("target"))
            after = _without(_without(current, inner).unionByName(short).distinct(), dead)
            current = _replaced(after, "edges", current, state)
        elif n_dead:
            current = _replaced(_without(current, dead), "edges", current)
        else:
            more, rest = _colored(current)
            dropped(current)
            found, current = [*found, more], rest
        dropped(ends)
    dropped(current)
    if not found:
        return edges.select(F.col("source").alias("cycle"), F.col("source").alias("id")).limit(0)
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    # What was taken out of a chain between two nodes of one component belongs to it.
    for chain in reversed(taken_out):
        before = known.select(F.col("id").alias("back"), "cycle")
        after = known.select(F.col("id").alias("ahead"), F.col("cycle").alias("same"))
        between = chain.join(before, "back").join(after, "ahead").where("cycle = same").select("cycle", "id")
        known = written(known.unionByName(between), "components")
    least = known.groupBy("cycle").agg(F.min("id").alias("least"))
    named = written(known.join(least, "cycle").select(F.col("least").alias("cycle"), "id"), "components")
    dropped(*found, *taken_out)
    return named


def witness_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(cycle, position, id): of each component one cycle, from its least node on; the last position leads back to the first."""
    inside = edges.select("source", "target").distinct()
    for end in ("source", "target"):
        inside = inside.join(components.select(F.col("id").alias(end), F.col("cycle").alias(f"{end}_cycle")), end)
    step = inside.where("source_cycle = target_cycle").groupBy(F.col("source").alias("id"), F.col("source_cycle").alias("cycle")).agg(F.min("target").alias("far"))
    # far: 2**k steps on; low: the least node of the 2**k steps from here; at: how many steps away.
    state = written(step.select("id", "cycle", "far", F.col("id").alias("low"), F.lit(0).cast("long").alias("at")), "walks")
    largest = components.groupBy("cycle").count().agg(F.max("count")).first()[0] or 0
    length = 1
    while length < largest:
        on = state.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("at").alias("at2"))
        below = F.col("low2") < F.col("low")
        walked = state.join(on, "far").select("id", "cycle", F.col("far2").alias("far"), F.least("low", "low2").alias("low"), F.when(below, F.col("at2") + length).otherwise(F.col("at")).alias("at"))
        state = _replaced(walked, "walks", state)
        length *= 2
    ended = state.join(state.select(F.col("far").alias("id")).distinct(), "id", "left_semi")
    rings = ended.groupBy("cycle", "low").agg(F.count("*").alias("size"))
    first = rings.groupBy("cycle").agg(F.min(F.struct("low", "size")).alias("ring")).select("cycle", "ring.low", "ring.size")
    return ended.join(first, ["cycle", "low"]).select("cycle", F.expr("(size - at) % size").alias("position"), "id")
