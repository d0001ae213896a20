"""Claim ledgers: the durable claims of a committed run beside its canonical note, written out and checked.

Records are compared by their canonical JSON (sorted keys, no blanks), digested in the order of their lines.  Numbers keep the
form that Python gives them, which the built-in JSON functions don't, so the canonical text is an Arrow UDF; the digests are columns.
A ledger and a run's claims are files of their own, so what one digest gathers is one file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.functions.batches import arrow_rows_udf
from vellumspark.functions.text import safe_id
from vellumspark.operators.rules import latest_per_output

# The note that a ledger lies beside, and its header.
CANONICAL_NOTE = "solution-space.md"
_RECORD = T.StructType([T.StructField("line", T.StringType()), T.StructField("durable", T.BooleanType()), T.StructField("id", T.StringType())])


def canonical_json(text: str | None) -> tuple[str | None, bool, str | None]:
    """(canonical text, whether it is durable, its id) of one record; no text if it isn't JSON."""
    try:
        record = json.loads(text or "")
        line = json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None, False, None
    if not isinstance(record, dict):
        return line, False, None
    name = next((record[k] for k in ("fact_id", "claim_id", "mechanism_id") if record.get(k)), "")
    return line, record.get("durable") is True, str(name)


canonical_udf = arrow_rows_udf(_RECORD, lambda text: dict(zip(("line", "durable", "id"), canonical_json(text))))


def _digest(order: list[Column], line: Column, keep: Column | None = None) -> Column:
    """The sha256 of lines in an order, joined by line feeds; null if one of them is no JSON."""
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), line.alias("line"))
    rows = F.collect_list(place if keep is None else F.when(keep, place))
    joined = F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), "\n")
    sound = F.count_if(line.isNull()) == 0
    return F.when(sound, F.sha2(joined, 256))


def claim_digests(claims: DataFrame) -> DataFrame:
    """(run_id, durable, source, n_durable) of (run_id, line_no, record) rows: the digest of the durable ones in their order, of all by id, and their number."""
    read = claims.withColumn("c", canonical_udf("record"))
    return read.groupBy("run_id").agg(
        _digest([F.col("line_no")], F.col("c.line"), F.col("c.durable")).alias("durable"),
        _digest([F.col("c.id"), F.col("line_no")], F.col("c.line")).alias("source"),
        F.count_if("c.durable").alias("n_durable"),
    )


def export_ledgers(claims: DataFrame) -> DataFrame:
    """(run_id, line_no, line): the ledger of each run with durable claims."""
    digests = claim_digests(claims).where("n_durable > 0 and source is not null")
    head = F.array(F.lit("schema_version: 1"), F.concat(F.lit("generated_from_run: "), "run_id"), F.concat(F.lit("durable_claims_sha256: "), "durable"), F.concat(F.lit("claims_source_sha256: "), "source"), F.lit("claims:"))
    first = digests.select("run_id", F.posexplode(head).alias("k", "line")).select("run_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")
    kept = claims.withColumn("c", canonical_udf("record")).where("c.durable").join(digests.select("run_id"), "run_id", "left_semi")
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("line_no")) + 5
    return first.unionByName(kept.select("run_id", number.cast("long").alias("line_no"), F.concat(F.lit("  - "), "c.line").alias("line")))


def read_ledgers(lines: DataFrame) -> DataFrame:
    """(ledger, run_id, stated, listed) of (ledger, line_no, line): its run, the digest that its header states and that of its records."""
    field = lambda name: F.max_by(F.regexp_replace(F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)), '^"+|"+$', ""), F.when(F.col("line").rlike(f"^{name}:"), F.col("line_no")))
    record = F.when(F.trim("line").startswith("- {"), F.substring(F.trim("line"), F.lit(3), F.length("line")))
    read = lines.withColumn("record", record).withColumn("c", canonical_udf("record"))
    is_record = F.col("record").isNotNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_record, F.struct("line_no", "c.line")))), lambda r: r["line"]), "\n")
    sound = F.count_if(is_record & F.col("c.line").isNull()) == 0
    return read.groupBy("ledger").agg(F.nullif(field("generated_from_run"), F.lit("")).alias("run_id"), F.nullif(field("durable_claims_sha256"), F.lit("")).alias("stated"), F.when(sound, F.sha2(joined, 256)).alias("listed"))


def ledger_issues(lines: DataFrame, runs: DataFrame, claims: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, ledger, run, active_run) of ledgers that are out of date or differ from what was accepted.

    ``runs`` (run_id, state) and ``claims`` (run_id, line_no, record) are the archived ones where there are such; ``entries`` are
    the acceptances (run_id, output, finalized_at).  A ledger without a run, or whose note a later run rewrote, is stale; one
    whose run is not there or not committed, or whose records or stated digest are not those of the run's durable claims, has drifted."""
    folder = F.regexp_extract("ledger", "^(.*/)?[^/]*$", 1)
    active = latest_per_output(entries).select(F.col("output"), F.col("run_id").alias("active_run"))
    read = read_ledgers(lines).withColumn("output", F.concat(folder, F.lit(CANONICAL_NOTE)))
    held = read.join(runs.select("run_id", "state"), "run_id", "left").join(active, "output", "left").join(claim_digests(claims), "run_id", "left")
    durable = F.coalesce("durable", F.when(F.col("n_durable").isNull(), F.sha2(F.lit("").cast("binary"), 256)))
    committed = F.coalesce(safe_id("run_id") & (F.col("state") == "COMMITTED"), F.lit(False))
    superseded = F.coalesce(F.col("active_run") != F.col("run_id"), F.lit(False))
    agrees = F.coalesce((F.col("stated") == durable) & (F.col("listed") == durable), F.lit(False))
    kind = F.when(F.col("run_id").isNull(), "CLAIM_LEDGER_STALE").when(~committed, "CLAIM_LEDGER_DRIFT").when(superseded, "CLAIM_LEDGER_STALE").when(~agrees, "CLAIM_LEDGER_DRIFT")
    return held.select(kind.alias("kind"), "ledger", F.when(kind == "CLAIM_LEDGER_STALE", F.col("run_id")).alias("run"), F.when((kind == "CLAIM_LEDGER_STALE") & F.col("run_id").isNotNull(), F.col("active_run")).alias("active_run")).where("kind is not null")
