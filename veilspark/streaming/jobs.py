"""Structured Streaming: decisions and detection per message, session counters, pairing with watermarks, windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.detect import acted, findings, without_overlaps
from veilspark.operators.policy import Rule, decide


def guard(calls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Stateless: each call with its decision; the same expression as in batch."""
    return decide(calls, rules)


def dlp(messages: DataFrame, text_col: str = "text", action: str = "redact") -> DataFrame:
    """Stateless: each message with its text acted on and the number of findings."""
    spans = messages.withColumn("_spans", F.explode(F.array(without_overlaps(findings(F.col(text_col))))))  # evaluated once
    return spans.withColumn("finding_count", F.size("_spans")).withColumn(text_col, acted(F.col(text_col), F.col("_spans"), action)).drop("_spans")


def session_counters(decided: DataFrame, late: str = "1 hour") -> DataFrame:
    """Keyed state per session and hour; a watermark lets go of old state."""
    count = lambda d: F.count_if(F.col("decision") == d)
    return decided.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "session_id").agg(F.count("*").alias("total_calls"), *[count(d).alias(f"{d}_count") for d in ("allow", "deny", "escalate")])


def session_windows(calls: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, started, calls: runs of calls without a longer gap; a watermark closes them and lets go of their state."""
    w = calls.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.min("ts").alias("started"), F.count("*").alias("calls"))
    return w.select(key, "started", "calls")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latencies(before: DataFrame, after: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and results joined by session and index, at most `late` apart, so that state is bounded."""
    b = before.withWatermark("ts", late).select("session_id", "call_index", F.col("ts").alias("before_ts"))
    a = after.withWatermark("ts", late).select(F.col("session_id").alias("_s"), F.col("call_index").alias("_i"), F.col("ts").alias("after_ts"))
    on = (F.col("session_id") == F.col("_s")) & (F.col("call_index") == F.col("_i")) & F.expr(f"after_ts between before_ts and before_ts + interval {late}")
    return b.join(a, on).drop("_s", "_i")


def batched(events: DataFrame, most: int = 20) -> DataFrame:
    """body, events: JSON arrays of up to `most` events each, for an upload; a micro-batch's rows, or a table's."""
    rows = events.select(F.to_json(F.struct("*")).alias("row"))

    def run(batches):
        held = []
        for b in batches:
            for row in b.column(0).to_pylist():
                held.append(row)
                if len(held) == most:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"]), pa.array([len(held)], pa.int32())], names=["body", "events"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"]), pa.array([len(held)], pa.int32())], names=["body", "events"])

    return rows.mapInArrow(run, "body string, events int")


def uploads(events: DataFrame, folder: str, checkpoint: str, most: int = 20, every: str | None = "30 seconds") -> StreamingQuery:
    """Writes batches of up to `most` events by the `every` of a clock, or what is there and ends; failed writes are left to a restart."""
    w = batched(events, most).writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every).start() if every else w.trigger(availableNow=True).start()


def run_available(out: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there in micro-batches into parquet files, exactly once, and ends."""
    q = out.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
