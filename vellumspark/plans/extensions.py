"""Window queries over events, and the journals of runs that events drive."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import rules
from vellumspark.operators.runs import STATES
from vellumspark.plans.registry import query, table
from vellumspark.streaming.events import sessions, tumbling
from vellumspark.streaming.runs import journals


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "1 day", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "1 hour", "user_id").withColumn("start", F.unix_micros("start"))


_KIND = "CASE WHEN event_id % 9 = 4 THEN 'artifact' WHEN event_id % 7 = 3 THEN 'failed' ELSE 'verified' END"


@query()
def run_journals(spark, sf_dir):
    """Each user's events as those of a research run; SQL can't fold them, so tests hold this against a plain fold."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "event_id", F.col("ts").alias("at"), F.expr(_KIND).alias("kind"), F.expr("CASE event_id % 3 WHEN 0 THEN 'facts' WHEN 1 THEN 'claims' ELSE 'mechanisms' END").alias("artifact"), F.concat(F.lit("d"), F.expr("event_id % 2")).alias("digest")
    )
    return journals(events).withColumn("at", F.unix_micros("at"))


@query("SELECT NULL::BIGINT AS run, NULL::BIGINT AS seq, NULL::VARCHAR AS problem FROM events WHERE false")
def run_journal_issues(spark, sf_dir):
    """The batch journal check finds nothing in the journals that the fold makes."""
    return rules.journal_issues(run_journals(spark, sf_dir), list(STATES))
