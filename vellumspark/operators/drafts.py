"""The proof of drafts: every block's references exist, and what it says of all or of how many is covered by its claims.

An inverted list (one row a reference of a block) meets the artifacts once; what comes back to a block is bounded by
its own references.  Texts stay out of both shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.functions.batches import arrow_rows_udf
from vellumspark.functions.markdown import draft_blocks
from vellumspark.functions.text import machine_path, stated_counts, universal_wording

_BLOCKS = T.ArrayType(T.StructType([T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))


blocks_udf = arrow_rows_udf(_BLOCKS, lambda text: draft_blocks(text or ""))


def traced_blocks(drafts: DataFrame) -> DataFrame:
    """(draft, block, refs, text) of (draft, text) rows: the stretches behind the reference markers, numbered from 0."""
    return drafts.select("draft", F.posexplode(blocks_udf("text")).alias("block", "b")).select("draft", F.col("block").cast("long").alias("block"), "b.refs", "b.text")


def artifacts(facts: DataFrame, claims: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """(ref, mode, support, eligible): every id that a block may refer to.

    ``facts`` (fact_id), ``mechanisms`` (mechanism_id); ``claims`` (claim_id, coverage_mode, support_count,
    eligible_count), whose counts are null where the gate has not counted them."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("mode", "string"), ("support", "long"), ("eligible", "long"))]
    counted = claims.select(F.col("claim_id").alias("ref"), F.col("coverage_mode").alias("mode"), F.col("support_count").cast("long").alias("support"), F.col("eligible_count").cast("long").alias("eligible"))
    plain = facts.select(F.col("fact_id").alias("ref"), *none).unionByName(mechanisms.select(F.col("mechanism_id").alias("ref"), *none))
    both = counted.unionByName(plain).where("ref is not null")
    return both.groupBy("ref").agg(F.max_by(F.struct("mode", "support", "eligible"), F.coalesce("mode", F.lit(""))).alias("c")).select("ref", "c.*")


def block_proofs(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(draft, block, unknown, universal, needed, exact, covered): per block its references that no artifact has, whether
    it generalises, the counts it states, the computed counts of its exact claims, and whether one of its claims covers all."""
    universal = universal_wording("text")
    told = blocks.select("draft", "block", universal.alias("universal"), F.when(universal, F.array_distinct(stated_counts("text"))).alias("needed"), F.explode_outer("refs").alias("ref"))
    met = told.join(known.withColumn("known", F.lit(True)), "ref", "left")
    whole = (F.col("mode") == "all") & F.col("support").eqNullSafe(F.col("eligible"))
    found = met.groupBy("draft", "block").agg(
        F.array_sort(F.collect_set(F.when(F.col("ref").isNotNull() & F.col("known").isNull(), F.col("ref")))).alias("unknown"),
        F.any_value("universal").alias("universal"),
        F.any_value("needed").alias("needed"),
        F.array_sort(F.collect_set(F.when(F.col("mode") == "exact_count", F.col("support")))).alias("exact"),
        F.coalesce(F.bool_or(whole), F.lit(False)).alias("covered"),
    )
    return found


def block_errors(proofs: DataFrame) -> DataFrame:
    """(draft, block, code, detail) of the blocks that are not proven.

    Counts, where a generalising block states any, must each be an exact claim's; otherwise a claim must cover all."""
    counted = F.forall("needed", lambda n: F.coalesce(F.array_contains(F.col("exact"), n), F.lit(False)))
    proven = ~F.col("universal") | F.when(F.size("needed") > 0, counted).otherwise(F.col("covered"))
    codes = F.array(
        F.when(F.size("unknown") > 0, F.struct(F.lit("UNKNOWN_REFS").alias("code"), F.array_join("unknown", ",").alias("detail"))),
        F.when(~proven, F.struct(F.lit("UNIVERSAL_WORDING_UNVERIFIED").alias("code"), F.array_join("needed", ",").alias("detail"))),
    )
    return proofs.select("draft", "block", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("c")).select("draft", "block", "c.code", "c.detail")


def _missing_sections(text, sections):
    """A heading of any level, whatever its case, that begins with the section's name as a whole word."""
    pattern = lambda s: F.concat(F.lit("(?mdiuU)^#{1,6}\\s+\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?:\\s|$)"))
    return F.filter(sections, lambda s: ~F.regexp_like(text, pattern(s)))


def draft_errors(drafts: DataFrame, contracts: DataFrame) -> DataFrame:
    """(draft, code, detail) of whole drafts against ``contracts`` (draft, sections, labels, min_chars); a draft without
    a contract is only searched for paths of stores."""
    held = drafts.join(contracts, "draft", "left").withColumn("text", F.coalesce("text", F.lit("")))
    shown = F.regexp_replace("text", "(?sU)^---.*?---\\s*", "")
    chars = F.length(F.regexp_replace(shown, "(?U)^\\s+|\\s+\\z", ""))
    none = F.array().cast("array<string>")
    fail = lambda values, what: F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit("DOCUMENT_COMPLETENESS_FAIL").alias("code"), F.concat(F.lit(what), v).alias("detail")))
    labels = F.filter("labels", lambda v: ~F.contains(F.col("text"), v))
    one = lambda test, code, detail: F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(code).alias("code"), detail.alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))
    thin = one((F.col("min_chars") > 0) & (chars < F.col("min_chars")), "SUSPICIOUSLY_THIN_OUTPUT", chars.cast("string"))
    leak = one(machine_path("text"), "MACHINE_PATH_LEAK", F.lit(""))
    codes = F.concat(fail(_missing_sections(F.col("text"), F.col("sections")), "section "), fail(labels, "label "), thin, leak)
    return held.select("draft", F.explode(codes).alias("c")).select("draft", "c.code", "c.detail")


def stale_artifacts(gates: DataFrame, current: DataFrame) -> DataFrame:
    """(draft, code, detail): artifacts (draft, artifact, digest) that are no longer what the gate recorded."""
    now = current.select("draft", "artifact", F.col("digest").alias("now"))
    return gates.join(now, ["draft", "artifact"], "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("draft", F.lit("STALE_HASHES").alias("code"), F.col("artifact").alias("detail"))


def verify_drafts(drafts: DataFrame, known: DataFrame, contracts: DataFrame, gates: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """(draft, block, code, detail): all that keeps drafts from being final, and the warning about thin ones."""
    found = block_errors(block_proofs(traced_blocks(drafts), known))
    whole = draft_errors(drafts, contracts)
    if gates is not None and current is not None:
        whole = whole.unionByName(stale_artifacts(gates, current))
    return found.unionByName(whole.select("draft", F.lit(None).cast("long").alias("block"), "code", "detail"))
