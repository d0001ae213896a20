"""A Merkle manifest of a dataset: digests of all rows under one root, and a proof for each row.

Bottom up, every run of ``FANOUT`` consecutive nodes of a group becomes one parent, until each group has one node left;
these, in the order of their groups, become leaves of a last tree of their own.  Every level is written to the shared
folder.  Top down, each level's children join their parents: a child puts its own siblings in front of the proof that
its parent inherited, so a proof needs one narrow join a level and never a whole group in one place.

Ranks inside a group come from a range partitioning by (group, id, digest) and the number of rows before each
partition, so a group may hold any share of the rows.

Digests are lowercase hexadecimal sha256 of concatenated inputs, inner digests as text.  A leaf's inputs are its
columns: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value.

Defined cases: a null group is a group of its own and comes first, then groups by their UTF-8 bytes; null ids come first
in their group; rows of one id go by their leaf digest, and repeated rows are leaves of their own with proofs of
their own; empty texts differ from null ones; long texts are digested whole, inside the scan; an empty table has an empty
manifest and no root; further columns are not digested, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*columns: Column) -> Column:
    def framed(column: Column) -> Column:
        value = column.cast("string").cast("binary")
        return F.coalesce(F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(":").cast("binary"), value), F.lit("-").cast("binary"))

    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def group_key(column: Column) -> Column:
    """A group as text that keeps null apart and first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``idx``, the rank in its ``grp`` by ``order``, and ``n``, the number of the group's rows.

    Sorted partitions are written with the place of each row; per partition and group one row with its first place and
    count leaves them, and running sums over these give the ranks.
    """
    spark = nodes.sparkSession
    dealt = nodes.repartitionByRange(parts(spark), "grp", *order).sortWithinPartitions("grp", *order)
    placed = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), f"{name}-placed")
    held = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    found = placed.join(starts, ["grp", "part"]).select(*nodes.columns, (F.col("place") + F.col("shift")).alias("idx"), "n")
    found._vellum_placed = placed
    return found


def _parents(nodes: DataFrame) -> DataFrame:
    """One node for each run of the groups that have several nodes; it knows its children's digests."""
    runs = nodes.where("n > 1").groupBy("grp", F.expr(f"idx div {FANOUT}").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
    children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda c: c["digest"])
    return runs.agg(children.alias("children")).select("grp", "idx", "n", F.sha2(F.concat_ws("", "children"), 256).alias("digest"), "children")


def build_levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written levels over ``leaves`` (grp, idx, n, digest), leaves first; the number of levels grows with the logarithm of the largest group."""
    levels, largest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        levels.append(materialize(_parents(levels[-1]), f"{name}-level{len(levels)}"))
        largest = (largest + FANOUT - 1) // FANOUT
    return levels


_PROOF = "array<struct<left:string,right:string>>"


def push_proofs(levels: list[DataFrame], inherited: DataFrame, name: str) -> list[DataFrame]:
    """Per level its nodes with ``proof``: the siblings left and right of it, then those of its parent, and so on.

    ``inherited`` has (grp, proof) of the node that each group ends in, and further columns that go down with it, so
    that no join is keyed by the group of a leaf alone.
    """
    down = [c for c in inherited.columns if c not in ("grp", "proof")]
    out: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        plain = [c for c in levels[k].columns if c != "children"]
        here = levels[k].where("n = 1").join(inherited, "grp").select(*plain, "proof", *down)
        if out:
            up = out[0].select("grp", F.col("idx").alias("up"), F.col("children").alias("run"), F.col("proof").alias("rest"), *down)
            slot = F.expr(f"int(idx % {FANOUT})")
            beside = F.struct(F.concat_ws("", F.slice("run", F.lit(1), slot)).alias("left"), F.concat_ws("", F.slice("run", slot + 2, F.lit(FANOUT))).alias("right"))
            pushed = levels[k].where("n > 1").withColumn("up", F.expr(f"idx div {FANOUT}")).join(up, ["grp", "up"])
            here = here.unionByName(pushed.select(*plain, F.concat(F.array(beside), F.col("rest")).alias("proof"), *down))
        if k:  # the leaves' proofs are for the caller to read once
            here = materialize(here.join(levels[k].select("grp", "idx", "children"), ["grp", "idx"]), f"{name}-proofs{k}")
        out.insert(0, here)
    return out


@dataclass
class Manifest:
    """Written levels of the groups' trees and of the tree over them."""

    levels: list[DataFrame]
    top: list[DataFrame]
    temporary: list[DataFrame] = field(default_factory=list)

    def root(self) -> str | None:
        found = self.top[-1].where("n = 1").select("digest").first()
        return found[0] if found else None

    def subroots(self) -> DataFrame:
        return _subroots(self.levels)

    def save(self, path: str) -> None:
        for part, frames in (("levels", self.levels), ("top", self.top)):
            for k, frame in enumerate(frames):
                frame.write.mode("overwrite").parquet(f"{path}/{part}/{k}")
        sizes = [(len(self.levels), len(self.top))]
        self.levels[0].sparkSession.createDataFrame(sizes, "levels int, top int").write.mode("overwrite").parquet(f"{path}/sizes")

    def discard(self) -> None:
        discard(self.levels[0].sparkSession, *self.levels, *self.top, *self.temporary)


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    sizes = spark.read.parquet(f"{path}/sizes").first()
    return Manifest(*([spark.read.parquet(f"{path}/{part}/{k}") for k in range(sizes[part])] for part in ("levels", "top")))


def _subroots(levels: list[DataFrame]) -> DataFrame:
    ends = [level.where("n = 1").select("grp", "digest") for level in levels]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return found


def build_manifest(leaves: DataFrame, name: str = "merkle") -> Manifest:
    """The manifest of ``leaves`` (grp, id, digest and further columns, which stay with the leaves)."""
    written = materialize(leaves, f"{name}-digests")
    numbered = ranked(written, ["id", "digest"], name)
    bottom = materialize(numbered, f"{name}-level0")
    discard(leaves.sparkSession, written, numbered._vellum_placed)
    levels = build_levels(bottom, name)
    tops = _subroots(levels).select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest")
    placed = ranked(tops, ["id"], f"{name}-top")
    top = build_levels(materialize(placed, f"{name}-top0"), f"{name}-top")
    discard(leaves.sparkSession, placed._vellum_placed)
    return Manifest(levels, top)


def proofs(manifest: Manifest, name: str = "merkle") -> DataFrame:
    """The leaves' columns with ``proof``, the siblings from the leaf's run up to the root's, ``subroot`` and ``root``."""
    spark = manifest.levels[0].sparkSession
    over = push_proofs(manifest.top, spark.createDataFrame([("", [])], f"grp string, proof {_PROOF}"), f"{name}-top")
    root = F.lit(manifest.root()).cast("string").alias("root")
    inherited = materialize(over[0].select(F.col("id").alias("grp"), "proof", F.col("digest").alias("subroot"), root), f"{name}-inherited")
    below = push_proofs(manifest.levels, inherited, name)
    manifest.temporary += [inherited, *over[1:], *below[1:]]
    return below[0]


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def verify(presented: DataFrame, proven: DataFrame) -> DataFrame:
    """(id, digest, verified) of each different presented (id, digest): whether it folds to the root by a proof of that id."""
    asked = presented.select("id", "digest").distinct()
    known = proven.select(F.col("id").alias("known"), "root", "proof")
    met = asked.join(known, F.col("id").eqNullSafe(F.col("known")), "left").withColumn("met", folded(F.col("digest"), F.col("proof")) == F.col("root"))
    return met.groupBy("id", "digest").agg(F.coalesce(F.max("met"), F.lit(False)).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """Leaves of documents by language.  ``presented`` is the digest that a later check meets: that of the row with ``altered`` as its text where ``tampered``, else the leaf."""
    columns = [F.col(c) for c in COLUMNS]
    leaf = leaf_digest(*columns)
    shown = leaf if tampered is None else F.when(tampered, leaf_digest(*columns[:-1], altered))
    rows = docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf.alias("digest"), shown.alias("presented"))
    return rows.withColumn("presented", F.coalesce("presented", "digest"))


def digest_proofs(proven: DataFrame) -> DataFrame:
    """One row a leaf: its digests, that of its proof, and whether what was presented folds to the root."""
    rows = proven.withColumn("folded_root", folded(F.col("presented"), F.col("proof")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
