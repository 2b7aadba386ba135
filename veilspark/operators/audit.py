"""Audit logs: filters, statistics, tails, sessions, and pairing of calls with their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filtered(log: DataFrame, as_of: Column | None = None, last_hours: float | None = None, session_id: str = "", tool_name: str = "", decision: str = "", phase: str = "") -> DataFrame:
    """Empty arguments don't filter; the tool is a substring; rows without a valid timestamp go only under a cutoff."""
    for column, value in (("phase", phase), ("session_id", session_id), ("decision", decision)):
        log = log.where(F.col(column) == value) if value else log
    log = log.where(F.coalesce("tool_name", F.lit("")).contains(tool_name)) if tool_name else log
    if last_hours is not None:
        since = (as_of if as_of is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(last_hours * 3600.0))
        log = log.where(F.try_to_timestamp(F.col("timestamp").cast("string")) >= since)
    return log


def stats(log: DataFrame) -> DataFrame:
    """One row: calls and decisions before calls, results with personal data after them."""
    before = F.col("phase") == "before_call"
    count = lambda d: F.count_if(before & (F.col("decision") == d))
    pii = F.count_if((F.col("phase") == "after_call") & F.coalesce(F.col("pii_count") > 0, F.lit(False)))
    return log.agg(F.count_if(before).alias("total_calls"), count("allow").alias("allowed"), count("deny").alias("denied"), count("escalate").alias("escalated"), pii.alias("pii_detections"))


def top(log: DataFrame, column: str, k: int = 10, seen: str = "call_id") -> DataFrame:
    """The k most frequent values with their counts; of equal counts the first seen comes first."""
    counts = log.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k).select("key", "n")


def tail(log: DataFrame, k: int, *order: str) -> DataFrame:
    """The last k rows, the last one first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(k)


def sessions(calls: DataFrame) -> DataFrame:
    """Per session: calls, decisions, distinct tools, most denied tool, first and last time."""
    count = lambda d: F.count_if(F.col("decision") == d)
    per_tool = calls.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), *[count(d).alias(d) for d in ("allow", "deny", "escalate")], F.min("ts").alias("a"), F.max("ts").alias("b"))
    worst = F.min_by("tool_name", F.when(F.col("deny") > 0, F.struct(-F.col("deny"), F.col("tool_name"))))
    return per_tool.groupBy("session_id").agg(F.sum("calls").alias("total_calls"), F.sum("allow").alias("allow_count"), F.sum("deny").alias("deny_count"), F.sum("escalate").alias("escalate_count"), F.count("*").alias("unique_tools"), worst.alias("top_denied_tool"), F.min("a").alias("started_at"), F.max("b").alias("ended_at"))


def counters(decided: DataFrame) -> DataFrame:
    """One row: what an adapter counts over all its calls."""
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return decided.agg(F.count("*").alias("total"), count("allow"), count("deny"), count("escalate"))


def hourly(decided: DataFrame) -> DataFrame:
    """Per hour and session: calls and denials."""
    hour = F.date_trunc("hour", F.col("ts")).cast(decided.schema["ts"].dataType)
    return decided.groupBy(hour.alias("hour"), "session_id").agg(F.count("*").alias("total_calls"), F.count_if(F.col("decision") == "deny").alias("deny_count"))


def first_seen(calls: DataFrame, key: str, tool: str, order: str) -> DataFrame:
    """key, tool, first_seen, position: each tool of a session once, in the order in which they were first called."""
    first = calls.groupBy(key, tool).agg(F.min(order).alias("first_seen"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("first_seen")).cast("long"))


def session_windows(calls: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, started, calls: runs of calls with no gap above `gap`; the same expression as in a stream."""
    kind = calls.schema["ts"].dataType
    w = calls.select(key, F.col("ts").cast("timestamp").alias("ts")).groupBy(key, F.session_window("ts", gap)).agg(F.min("ts").alias("started"), F.count("*").alias("calls"))
    return w.select(key, F.col("started").cast(kind).alias("started"), "calls")


def numbered(calls: DataFrame) -> DataFrame:
    return calls.withColumn("call_index", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "call_id")))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Latency of each call that has a result, by session and index."""
    b, a = before.select("session_id", "call_index", F.col("ts").alias("before_ts")), after.select("session_id", "call_index", F.col("ts").alias("after_ts"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return b.join(a, ["session_id", "call_index"]).select("session_id", "call_index", ((us("after_ts") - us("before_ts")) / 1000).alias("latency_ms"))
