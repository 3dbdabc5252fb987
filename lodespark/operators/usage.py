"""Usage of the engine from its access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_lines(log: DataFrame, key: str = "log_id") -> DataFrame:
    """The log without repeated lines: of lines equal but for the id the first."""
    own = [c for c in log.columns if c != key]
    return log.groupBy(*own).agg(F.min(key).alias(key)).select(*log.columns)


def within(log: DataFrame, until, days: int, at: str = "logged_at") -> DataFrame:
    """Lines of the last ``days`` days up to ``until``, both ends included."""
    end = F.lit(until).cast("timestamp_ntz")
    return log.where((F.col(at) >= end - F.expr(f"interval {int(days)} days")) & (F.col(at) <= end))


def report(log: DataFrame, until, days: int = 30) -> DataFrame:
    """One row: events, distinct query hashes, mean results, redactions and the last event of the window."""
    return within(log, until, days).agg(
        F.count("*").alias("events"), F.countDistinct("query_hash").alias("query_hashes"), F.avg("result_count").alias("avg_results"),
        F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions"), F.max("logged_at").alias("last_event_at"),
    )


def by_action(log: DataFrame, until, days: int = 30) -> DataFrame:
    """The report by action; a null action is a group of its own."""
    return within(log, until, days).groupBy("action_name").agg(F.count("*").alias("events"), F.countDistinct("query_hash").alias("query_hashes"), F.avg("result_count").alias("avg_results"))


def retained(log: DataFrame, lines: int, order: str = "log_id") -> DataFrame:
    """The newest ``lines`` lines, newest by ``order``."""
    return log.orderBy(F.desc(order)).limit(lines)


def output_savings(log: DataFrame) -> DataFrame:
    """Bytes retrieved, returned and saved by tool, with the share saved and how many answers were cut."""
    got, sent = F.sum("retrieved_bytes"), F.sum("returned_bytes")
    return log.groupBy("tool").agg(
        F.count("*").alias("responses"), got.alias("retrieved_bytes"), sent.alias("returned_bytes"), (got - sent).alias("saved_bytes"),
        F.when(got > 0, 1 - sent / got).alias("reduction_ratio"), F.count_if("compacted").alias("compacted"), F.count_if("truncated").alias("truncated"),
    )


def sessions(log: DataFrame, by: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """(by, session, started, ended, events): runs of events with no gap above ``gap_minutes``. Not in the reference."""
    own = Window.partitionBy(by).orderBy(at)
    new = F.when(F.lag(at).over(own).isNull() | (F.col(at) > F.lag(at).over(own) + F.expr(f"interval {gap_minutes} minutes")), 1).otherwise(0)
    marked = log.withColumn("new", new).withColumn("session", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))
