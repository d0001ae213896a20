"""The project DAG: roots, several parents, cycles, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.components import strong_components
from vellumspark.tables import dropped, written


def on_cycle(edges: DataFrame) -> DataFrame:
    """(id): nodes that reach themselves."""
    return strong_components(edges).select("id")


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, id): the nodes that reach each other, each such set named by its least node."""
    return strong_components(edges)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent among (parent, child) edges."""
    return nodes.select("id").join(edges.select(F.col("child").alias("id")), "id", "left_anti")


def multi_parent(edges: DataFrame) -> DataFrame:
    """(child, parents): children of several distinct parents."""
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents")).where(F.size("parents") > 1)


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, id): what each label's ``seeds`` (label, id) reach over (source, target) edges, themselves included.

    Only what a round adds goes on to the next, and each round is written, so that cycles end and lineage stays short."""
    step = edges.select(F.col("source").alias("id"), "target").distinct()
    known = added = written(seeds.select("label", "id").distinct(), "reach")
    rounds = [known]
    while True:
        new = added.join(step, "id").select("label", F.col("target").alias("id")).distinct().join(known, ["label", "id"], "left_anti")
        added = written(new, "reach")
        if added.isEmpty():
            return known
        rounds.append(added)
        known = known.unionByName(added)
        if len(rounds) > 8:  # one table again instead of one a round
            known = written(known, "reach")
            dropped(*rounds[:-1])
            rounds = [rounds[-1], known]


def transitive_impact(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Nodes that derive from the ``direct`` ones over (source derived from target), without these."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    reached = reach(back, direct.select(F.lit(0).alias("label"), "id")).select("id")
    return reached.join(direct.select("id"), "id", "left_anti")
