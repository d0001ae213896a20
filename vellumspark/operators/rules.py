"""Rules as constraint queries: each gives (kind, subject, detail) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import machine_path, universal_wording


def issues(rows: DataFrame, kind: str, subject: Column | str, detail: Column | None = None) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def report(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


# Content reports ----------------------------------------------------------


def canonical_duplication(paragraphs: DataFrame, least: int = 180) -> DataFrame:
    """(folder, paragraph, owners): long paragraphs of (folder, doc, paragraph) in several documents of a folder."""
    compact = F.regexp_replace(F.trim(F.regexp_replace("paragraph", "[ \\t]*\\n[ \\t\\n]*", " ")), "^ +| +$", "")
    long = paragraphs.withColumn("paragraph", compact).where(F.length("paragraph") >= least)
    return long.groupBy("folder", "paragraph").agg(F.array_sort(F.collect_set("doc")).alias("owners")).where(F.size("owners") > 1)


def density(docs: DataFrame) -> DataFrame:
    """Thin documents of (id, name, n_refs, body): by name or number of references."""
    threshold = F.when(F.col("name") == "solutions.md", 3000).when(F.col("name") == "solution-space.md", 2500).when(F.col("n_refs") >= 4, 2000)
    role = F.when(F.col("name") == "solutions.md", "solutions").when(F.col("name") == "solution-space.md", "solution-space").when(F.col("n_refs") >= 4, "multi-source-focused")
    sized = docs.select("id", role.alias("role"), F.length(F.trim("body")).cast("long").alias("chars"), threshold.cast("long").alias("threshold"))
    return sized.where("chars < threshold")


# Research gate ------------------------------------------------------------


def fact_coverage(entities: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """(entity, facts): expected entities with fewer than ``least`` facts."""
    counted = facts.groupBy("entity").agg(F.count("*").alias("facts"))
    return entities.join(counted, "entity", "left").select("entity", F.coalesce("facts", F.lit(0)).alias("facts")).where(F.col("facts") < least)


def axis_coverage(required: DataFrame, facts: DataFrame) -> DataFrame:
    """Required (entity, axis) without a fact."""
    return required.select("entity", "axis").join(facts, ["entity", "axis"], "left_anti")


def last_verdicts(verdicts: DataFrame, key: str) -> DataFrame:
    """The last verdict of each key by line; for status checks."""
    return verdicts.groupBy(key).agg(F.max_by(F.struct("status", "line"), "line").alias("v")).select(key, F.col("v.status").alias("status"))


def failed_verdicts(verdicts: DataFrame, key: str) -> DataFrame:
    """Keys with any FAIL row, even if a later one passes."""
    return verdicts.where("status = 'FAIL'").select(key).distinct()


def attribution(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts (fact_id, entity, solution_id, source_id, evidence_type) whose id, owner or source disagree."""
    joined = facts.join(sources.select("source_id", F.col("solution_id").alias("owner"), "available"), "source_id", "left")
    problem = (
        F.when(F.col("entity") != F.col("solution_id"), "FACT_ATTRIBUTION_ERROR: id")
        .when(F.col("owner").isNull(), "source not in manifest")
        .when(F.col("owner") != F.col("solution_id"), "FACT_ATTRIBUTION_ERROR: source")
        .when((F.col("evidence_type") == "code_demonstrated") & ~F.array_contains("available", "repository"), "code_demonstrated without repository")
    )
    return joined.select("fact_id", problem.alias("problem")).where("problem is not null")


def claim_support(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, support_count, eligible_count, ratio, covers_all) from claims with
    support_fact_ids and eligible_entities and facts (fact_id, solution_id)."""
    support = claims.select("claim_id", F.explode("support_fact_ids").alias("fact_id")).join(facts.select("fact_id", "solution_id"), "fact_id")
    held = support.groupBy("claim_id").agg(F.array_sort(F.collect_set("solution_id")).alias("held"))
    wide = claims.select("claim_id", F.array_sort(F.array_distinct("eligible_entities")).alias("eligible")).join(held, "claim_id", "left")
    held = F.coalesce("held", F.array().cast("array<string>"))
    ratio = F.coalesce(F.try_divide(F.size(held).cast("double"), F.size("eligible").cast("double")), F.lit(0.0))
    return wide.select("claim_id", F.size(held).cast("long").alias("support_count"), F.size("eligible").cast("long").alias("eligible_count"), F.round(ratio, 6).alias("ratio"), (held == F.col("eligible")).alias("covers_all"))


def quantifier_failures(claims: DataFrame, support: DataFrame) -> DataFrame:
    """Claims whose universal wording or coverage mode their support does not carry."""
    strong = F.col("claim_type").isin("convergence", "mechanism", "principle")
    universal = universal_wording("statement")
    wrong = (
        ((F.col("coverage_mode") == "all") & ~F.col("covers_all"))
        | (F.col("coverage_mode").isNull() & universal & strong & ~F.col("covers_all"))
        | (F.col("coverage_mode").isNotNull() & (F.col("coverage_mode") != "all") & universal)
    )
    return claims.join(support.select("claim_id", "covers_all"), "claim_id").where(wrong).select("claim_id")


def decorative_counterexamples(claims: DataFrame) -> DataFrame:
    """Strong claims that list counter facts but draw no boundary."""
    strong = F.col("claim_type").isin("convergence", "mechanism", "principle")
    return claims.where(strong & (F.size("counter_fact_ids") > 0) & (F.trim(F.coalesce("boundary", F.lit(""))) == "")).select("claim_id")


def raw_references(claims: DataFrame) -> DataFrame:
    return claims.where(machine_path("statement")).select("claim_id")


def duplicate_mechanisms(mechanisms: DataFrame) -> DataFrame:
    """(intervention, variable, ids): one change named by several mechanism ids."""
    grouped = mechanisms.groupBy("intervention", F.lower("changed_variable").alias("variable")).agg(F.array_sort(F.collect_set("mechanism_id")).alias("ids"))
    return grouped.where(F.size("ids") > 1)


def unknown_references(blocks: DataFrame, *known: DataFrame) -> DataFrame:
    """References of draft blocks (block, refs) that name no known id."""
    ids = reduce(lambda a, b: a.unionByName(b), (k.select("id") for k in known)).distinct()
    return blocks.select("block", F.explode("refs").alias("id")).join(ids, "id", "left_anti").select("block", "id").distinct()


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def drifted(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Names whose (name, digest) is missing or another than the stored one."""
    return stored.join(current.select("name", F.col("digest").alias("now")), "name", "left").where(~F.col("now").eqNullSafe(F.col("digest"))).select("name")


# Journal and provenance ---------------------------------------------------


def journal_issues(journal: DataFrame, order: list[str]) -> DataFrame:
    """(run, seq, problem) of hash-chained entries (run, seq, state, previous, entry):
    gaps, broken links, unknown states and transitions that are neither the next
    state nor the one rollback."""
    w = Window.partitionBy("run").orderBy("seq")
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("state"))
    seen = journal.select("run", "seq", "state", "previous", "entry", F.lag("entry").over(w).alias("before"), F.lag("seq").over(w).alias("last"), rank.alias("r"), F.lag(rank).over(w).alias("q"))
    problem = (
        F.when(~F.col("previous").eqNullSafe(F.coalesce("before", F.lit(""))), "STATE_HISTORY_CHAIN_INVALID")
        .when(F.col("last").isNotNull() & (F.col("seq") != F.col("last") + 1), "STATE_HISTORY_CHAIN_INVALID")
        .when(F.col("r") == 0, "STATE_HISTORY_UNKNOWN_STATE")
        .when(F.col("q").isNotNull() & (F.col("r") != F.col("q") + 1) & ~((F.col("state") == "FACTS_READY") & (F.col("q") > F.col("r"))), "STATE_TRANSITION_INVALID")
    )
    return seen.select("run", "seq", problem.alias("problem")).where("problem is not null")


def active_acceptances(entries: DataFrame) -> DataFrame:
    """Acceptances (run_id, output, region, finalized_at) that none supersedes: of
    each output and region the last; a whole note evicts what came before it,
    a region evicts an earlier whole note."""
    at = F.struct("finalized_at", "run_id")
    w = Window.partitionBy("output")
    marked = entries.withColumn("at", at)
    marked = marked.withColumns({"whole_at": F.max(F.when(F.col("region").isNull(), F.col("at"))).over(w), "region_at": F.max(F.when(F.col("region").isNotNull(), F.col("at"))).over(w)})
    last = F.max("at").over(Window.partitionBy("output", "region"))
    marked = marked.withColumn("last", last).where("at = last")
    keep = F.when(F.col("region").isNull(), F.col("region_at").isNull() | (F.col("at") > F.col("region_at"))).otherwise(F.col("whole_at").isNull() | (F.col("at") > F.col("whole_at")))
    return marked.where(keep).select(*entries.columns)


def latest_per_output(entries: DataFrame) -> DataFrame:
    """The last acceptance of each output; ties go to the later run id."""
    return entries.groupBy("output").agg(F.max_by("run_id", F.struct("finalized_at", "run_id")).alias("run_id"))


def provenance_grade(bound: Column, total: Column) -> Column:
    return F.when((total > 0) & (bound == total), "bound").when(bound > 0, "mixed").otherwise("legacy-anchor-only")


def dataset_digest(rows: DataFrame, line: Column) -> DataFrame:
    """One row with the sha256 of the sorted lines: the same for any row order.
    Lines are digested first, so what is gathered is 64 bytes a row."""
    return rows.select(F.sha2(line, 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"))
