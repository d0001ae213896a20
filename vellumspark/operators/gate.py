"""The checks of a research gate as constraint queries: (kind, subject, detail) rows, none if a stage may go on.

Records are DataFrames of a run's files: facts (fact_id, solution_id, statement, evidence_ids), claims (claim_id,
claim_type, statement, support_fact_ids, counter_fact_ids, eligible_entities), mechanisms (mechanism_id, intervention,
changed_variable, support_claim_ids, boundary) and verdicts (kind, <id>, status and what a kind adds).  Codes are fixed
values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.rules import duplicates, issues, report

STATUSES = ("PASS", "FAIL", "AMBIGUOUS")
CLAIM_TYPES = ("observation", "convergence", "contradiction", "mechanism", "principle", "open_question")


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def _empty(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) <= 0


def manifest_issues(sources: DataFrame) -> DataFrame:
    """From (source_id, solution_id, available); a table without rows is an issue as well."""
    none = sources.agg(F.count("*").alias("n")).where("n = 0")
    named = sources.where(~_blank("source_id"))
    return report(
        issues(none, "manifest", F.lit(""), F.lit("no sources")),
        issues(sources.where(_blank("source_id")), "manifest", F.coalesce("solution_id", F.lit("")), F.lit("missing source_id")),
        issues(duplicates(named, "source_id"), "manifest", "source_id", F.lit("duplicate source_id")),
        issues(sources.where(_blank("solution_id")), "manifest", F.coalesce("source_id", F.lit("")), F.lit("missing solution_id")),
        issues(sources.where(_empty("available")), "manifest", F.coalesce("source_id", F.lit("")), F.lit("available is empty")),
    )


def plan_issues(entities: DataFrame, axes: DataFrame, sources: DataFrame) -> DataFrame:
    """From expected (entity), required (entity, axis) and the manifest's sources (solution_id)."""
    known = sources.select(F.col("solution_id").alias("entity")).distinct()
    return report(
        issues(duplicates(entities, "entity"), "plan", "entity", F.lit("duplicate entity")),
        issues(entities.distinct().join(known, "entity", "left_anti"), "plan", "entity", F.lit("COVERAGE_ENTITY_NOT_IN_MANIFEST")),
        issues(axes.select("entity").distinct().join(entities, "entity", "left_anti"), "plan", "entity", F.lit("axes of an unknown entity")),
        issues(axes.where(_blank("axis")), "plan", "entity", F.lit("blank axis")),
    )


def _verdict_issues(rows: DataFrame, verdicts: DataFrame, kind: str, key: str, failed: str) -> DataFrame:
    """Each of ``rows`` needs one of the fixed statuses in its last verdict, and not FAIL."""
    last = verdicts.groupBy(key).agg(F.max_by("status", "line").alias("status"), F.lit(True).alias("there"))
    both = rows.select(key).distinct().join(last, key, "left")
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    problem = F.when(F.col("there").isNull(), "no verdict").when(~known, "invalid status").when(F.col("status") == "FAIL", failed)
    return issues(both.withColumn("problem", problem).where("problem is not null"), kind, key, F.col("problem"))


def fact_issues(facts: DataFrame, verdicts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Verdicts (fact_id, status, line, statement_sha256, evidence: array of evidence_id and excerpt_sha256) against
    facts and bindings (evidence_id, excerpt_sha256): a verdict on another statement or excerpt is stale."""
    bound = facts.where(~_empty("evidence_ids"))
    last = verdicts.groupBy("fact_id").agg(F.max_by(F.struct("status", "statement_sha256", "evidence"), "line").alias("v"))
    judged = bound.join(last, "fact_id").where(F.col("v.status").isin(*STATUSES))
    words = judged.where(~F.coalesce(F.col("v.statement_sha256") == F.sha2(F.coalesce("statement", F.lit("")), 256), F.lit(False)))
    asked = judged.select("fact_id", F.explode("evidence_ids").alias("evidence_id"), "v")
    given = F.try_element_at(F.filter("v.evidence", lambda e: e["evidence_id"] == F.col("evidence_id")), F.lit(1))["excerpt_sha256"]
    met = asked.withColumn("given", given).join(bindings.select("evidence_id", "excerpt_sha256"), "evidence_id", "left")
    stale = words.select("fact_id").unionByName(met.where(~F.coalesce(F.col("given") == F.col("excerpt_sha256"), F.lit(False))).select("fact_id")).distinct()
    return report(_verdict_issues(facts, verdicts, "facts", "fact_id", "semantic verification FAIL"), issues(stale, "facts", "fact_id", F.lit("SEMANTIC_VERDICT_STALE")))


def _support(rows: DataFrame, key: str, ids: str, there: DataFrame, verdicts: DataFrame, own: str, kind: str, code: str) -> DataFrame:
    """Ids that rows rest on: each must exist and have passed."""
    asked = rows.select(key, F.explode(ids).alias(own)).distinct()
    status = verdicts.groupBy(own).agg(F.max_by("status", "line").alias("status"))
    known = asked.join(there.select(own).distinct(), own, "left_semi").join(status, own, "left")
    return report(
        issues(asked.join(there.select(own), own, "left_anti"), kind, key, F.concat(own, F.lit(" does not exist"))),
        issues(known.where("status is null or status <> 'PASS'"), kind, key, F.concat_ws(" ", F.lit(code), own)),
    )


def claim_issues(claims: DataFrame, facts: DataFrame, fact_verdicts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims rest on facts that passed; ``verdicts`` has kind, claim_id, claims, status and line."""
    own, against = verdicts.where("coalesce(kind, '') <> 'contradiction'"), verdicts.where("kind = 'contradiction' and status = 'FAIL'")
    counter = claims.select("claim_id", F.explode("counter_fact_ids").alias("fact_id")).distinct()
    return report(
        issues(duplicates(claims, "claim_id"), "claims", "claim_id", F.lit("duplicate claim_id")),
        issues(claims.where(~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False))), "claims", "claim_id", F.lit("unknown claim_type")),
        issues(claims.where(_blank("statement")), "claims", "claim_id", F.lit("missing statement")),
        issues(claims.where((F.col("claim_type") != "open_question") & _empty("support_fact_ids")), "claims", "claim_id", F.lit("support_fact_ids required")),
        issues(claims.where(F.col("counter_fact_ids").isNull()), "claims", "claim_id", F.lit("counter_fact_ids required")),
        issues(claims.where(_empty("eligible_entities")), "claims", "claim_id", F.lit("eligible_entities required")),
        _support(claims, "claim_id", "support_fact_ids", facts, fact_verdicts, "fact_id", "claims", "CLAIM_SUPPORT_FAIL"),
        issues(counter.join(facts.select("fact_id"), "fact_id", "left_anti"), "claims", "claim_id", F.concat(F.lit("counter "), "fact_id", F.lit(" does not exist"))),
        _verdict_issues(claims, own, "claims", "claim_id", "CLAIM_VERIFY_FAIL"),
        issues(against, "claims", F.array_join("claims", ","), F.lit("CLAIM_CONTRADICTION")),
    )


def mechanism_issues(mechanisms: DataFrame, claims: DataFrame, claim_verdicts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mechanisms rest on claims that passed; ``verdicts`` has kind, mechanism_id, mechanisms, status and line."""
    own, mixed = verdicts.where("coalesce(kind, '') <> 'conflation'"), verdicts.where("kind = 'conflation' and status = 'FAIL'")
    same = mechanisms.groupBy("intervention", F.lower("changed_variable").alias("changed")).agg(F.array_sort(F.collect_set("mechanism_id")).alias("ids")).where(F.size("ids") > 1)
    return report(
        issues(duplicates(mechanisms, "mechanism_id"), "mechanisms", "mechanism_id", F.lit("duplicate mechanism_id")),
        issues(mechanisms.where(_blank("boundary")), "mechanisms", "mechanism_id", F.lit("missing boundary")),
        _support(mechanisms, "mechanism_id", "support_claim_ids", claims, claim_verdicts.where("coalesce(kind, '') <> 'contradiction'"), "claim_id", "mechanisms", "support claim not verified PASS"),
        issues(same, "mechanisms", F.array_join("ids", ","), F.lit("MECHANISM_DUPLICATE")),
        _verdict_issues(mechanisms, own, "mechanisms", "mechanism_id", "MECHANISM_VERIFY_FAIL"),
        issues(mixed, "mechanisms", F.array_join("mechanisms", ","), F.lit("MECHANISM_CONFLATION")),
    )


def gate_issues(current: DataFrame, stored: DataFrame, claim_verdicts: DataFrame) -> DataFrame:
    """Digests (name, digest) as they are against the stored ones (null: none stored), and open contradictions."""
    both = stored.where("digest is not null").join(current.select("name", F.col("digest").alias("now")), "name", "left")
    open_ = claim_verdicts.where("kind = 'contradiction' and status = 'FAIL'").limit(1)  # one is enough to say so
    return report(issues(both.where(~F.col("now").eqNullSafe(F.col("digest"))), "gate", "name", F.lit("drift before gate")), issues(open_, "gate", F.lit(""), F.lit("unresolved contradictions remain")))
