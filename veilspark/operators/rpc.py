"""Messages and payloads: calls in JSON-RPC lines, answers to denied ones, and detection inside structured payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import detect

DENIED = -32001


def parsed_calls(lines: DataFrame) -> DataFrame:
    """lines with request_id, tool_name and arguments (map of text) of tool calls; null where a line isn't one.

    A call is a request with method tools/call and params, or a plain object with tool or tool_name, and arguments or args.
    """
    at = lambda x: F.get_json_object("line", x)
    rpc = (at("$.method") == "tools/call") & at("$.params").isNotNull()
    bare = at("$.method").isNull()
    tool = F.when(rpc, F.coalesce(at("$.params.name"), F.lit(""))).when(bare, F.nullif(F.coalesce(F.nullif(at("$.tool"), F.lit("")), at("$.tool_name")), F.lit("")))
    given = F.when(rpc, at("$.params.arguments")).when(bare, F.coalesce(at("$.arguments"), at("$.args")))
    arguments = F.coalesce(F.from_json(given, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return lines.withColumns({"request_id": at("$.id"), "tool_name": tool, "arguments": F.when(tool.isNotNull(), arguments)})


def denied_response(request_id: Column, reason: Column, policy: Column, suggestion: Column | None = None, name: str = "guard") -> Column:
    """The JSON-RPC error for a denied call; what is empty isn't named. An id of digits is a number."""
    data = F.struct(F.lit(True).alias("denied"), reason.alias("reason"), F.nullif(suggestion if suggestion is not None else F.lit(None).cast("string"), F.lit("")).alias("suggestion"), F.nullif(policy, F.lit("")).alias("policy_matched"))
    error = F.to_json(F.struct(F.lit(DENIED).alias("code"), F.concat(F.lit(f"{name}: "), reason).alias("message"), data.alias("data")))
    quoted = F.to_json(F.array(request_id.cast("string")))
    shown = F.when(request_id.rlike(r"^-?\d+$"), request_id).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), shown, F.lit(',"error":'), error, F.lit("}"))


def payload_text(payload: Column) -> Column:
    """The text of a payload map or array, its null values left out, in lines."""
    return F.array_join(payload, "\n")


def acted_map(payload: Column, action: str = "redact") -> Column:
    """A map of texts with each value acted on, its keys as they are."""
    return F.transform_values(payload, lambda k, v: detect.acted(v, detect.without_overlaps(detect.findings(v)), action))


def acted_array(payload: Column, action: str = "redact") -> Column:
    return F.transform(payload, lambda v: detect.acted(v, detect.without_overlaps(detect.findings(v)), action))


def redacted_arguments(calls: DataFrame, types: list[str] | None = None) -> DataFrame:
    """calls with the values of their arguments redacted, and how many arguments held a finding."""
    found = F.size(F.filter(F.map_values("arguments"), lambda v: F.size(detect.findings(v, types)) > 0))
    safe = F.transform_values("arguments", lambda k, v: detect.redacted(v, detect.without_overlaps(detect.findings(v, types))))
    return calls.withColumn("argument_findings", found).withColumn("arguments", safe)


def cache_key(version: Column, name: Column, description: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", version, name, description, model), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (version, tool_name, description, model) with the latest cached rewrite of their key (cache: key, rewritten, cached_at), null without one."""
    latest = cache.groupBy("key").agg(F.max_by("rewritten", "cached_at").alias("rewritten"))
    return requests.withColumn("key", cache_key(F.col("version"), F.col("tool_name"), F.col("description"), F.col("model"))).join(latest, "key", "left")


def after_calls(results: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is recorded after calls (session_id, call_index, tool_name, ts, result): a row of the audit log for each, with the
    kinds found in the result, and a row of the dataset's guard_events for those with any."""
    kinds = F.array_sort(F.array_distinct(F.transform(detect.without_overlaps(detect.findings(F.col("result"), types)), lambda x: x["type"])))
    found = results.withColumn("pii_detected", F.explode(F.array(kinds)))
    log = found.select(F.col("ts").cast("string").alias("timestamp"), F.lit("after_call").alias("phase"), "session_id", "tool_name", "call_index", "pii_detected")
    events = found.where(F.size("pii_detected") > 0).select("session_id", "tool_name", F.lit("after_call").alias("phase"), F.col("pii_detected").alias("pii_types"), F.col("ts").alias("recorded_at"))
    return log, events


def outgoing(messages: DataFrame, action: str = "redact") -> DataFrame:
    """messages (decision, text) of a server's side with forwarded and warning: denied ones are kept back, escalated ones go on
    with a warning, and what goes on is acted on; log_only leaves the text and counts."""
    spans = messages.withColumn("_f", F.explode(F.array(detect.without_overlaps(detect.findings(F.col("text"))))))
    sent = F.col("decision") != "deny"
    shaped = spans.withColumn("finding_count", F.size("_f")).withColumn("text", F.when(sent, detect.acted(F.col("text"), F.col("_f"), action))).drop("_f")
    return shaped.withColumn("forwarded", sent).withColumn("warning", F.when(F.col("decision") == "escalate", F.concat(F.lit("approval wanted: "), F.coalesce("reason", F.lit("")))) if "reason" in messages.columns else F.when(F.col("decision") == "escalate", F.lit("approval wanted")))
