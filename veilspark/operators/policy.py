"""Ordered first-match policies over tool calls, compiled to one CASE expression or joined as a table of rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """Matches a call if a tool pattern is found in its name (or any tool is meant) and all conditions hold."""

    name: str
    action: str
    tool: str | None = None
    args: dict[str, str] = field(default_factory=dict)
    any_tool: bool = False
    token_spent_gt: int | None = None
    chain_depth_gt: int | None = None
    reason: str = ""

    def matches(self, tool: Column, arguments: Column, tokens: Column, depth: Column) -> Column:
        if self.tool is None and not self.any_tool:
            return F.lit(False)
        parts = [tool.rlike(self.tool) if self.tool and not self.any_tool else F.lit(True)]
        parts += [F.coalesce(arguments[k], F.lit("")).rlike(p) for k, p in self.args.items()]
        parts += [tokens > self.token_spent_gt] if self.token_spent_gt is not None else []
        parts += [depth > self.chain_depth_gt] if self.chain_depth_gt is not None else []
        return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


# The three presets' rules.
READ, SHELL, QUERY = "read_file|get_file_text|file_read", "run_command|execute_command|shell_exec|run_terminal_cmd", "query|execute_sql|run_query|postgres_query"
SECRET_FILES = Rule("block-sensitive-files", "deny", READ, {"path": r"\.(env|key|pem|p12|credentials|secret|token)$"}, reason="Access to sensitive file type blocked")
SSH = Rule("block-ssh-keys", "deny", READ, {"path": r"\.ssh/"}, reason="SSH key access blocked")
REVERSE = Rule("block-reverse-shell", "deny", SHELL, {"command": r"(/dev/tcp/|nc\s+-e|ncat\s+-e|bash\s+-i)"}, reason="Reverse shell pattern blocked")
PRESETS = {
    "balanced": (
        SECRET_FILES, SSH,
        Rule("block-etc-sensitive", "deny", READ, {"path": "^/etc/(passwd|shadow|sudoers)"}, reason="System file access blocked"),
        Rule("block-destructive-shell", "deny", SHELL, {"command": r"(rm\s+-rf|chmod\s+777|mkfs|dd\s+if=|:()\{ :|\&\};:)"}, reason="Destructive shell command blocked"),
        Rule("block-curl-pipe-bash", "deny", SHELL, {"command": r"curl.*\|.*sh|wget.*\|.*sh|curl.*\|.*bash"}, reason="Remote code execution pattern blocked"),
        REVERSE,
        Rule("escalate-db-destructive", "escalate", QUERY, {"query": r"(?i)(DROP|TRUNCATE|DELETE\s+FROM\s+(?!.*WHERE))"}, reason="Destructive database operation requires approval"),
    ),
    "strict": (
        Rule("block-all-shell", "deny", SHELL + "|bash", reason="Shell execution not allowed in strict mode"), SECRET_FILES, SSH,
        Rule("block-system-files", "deny", READ, {"path": "^/(etc|var|usr|sys|proc|boot)/"}, reason="System directory access blocked"),
        Rule("block-home-dotfiles", "deny", READ, {"path": r"~/\.|/home/.*?/\."}, reason="Dotfile access blocked"),
        Rule("escalate-file-writes", "escalate", "write_file|create_file|edit_file|file_write", reason="File write requires approval in strict mode"),
        Rule("block-arbitrary-network", "escalate", "http_request|fetch|curl|wget", reason="Network request requires approval in strict mode"),
        Rule("block-db-destructive", "deny", QUERY, {"query": "(?i)(DROP|TRUNCATE|ALTER|DELETE|UPDATE)"}, reason="Destructive database operation blocked in strict mode"),
        Rule("cost-limit", "deny", any_tool=True, token_spent_gt=50000, reason="Session token budget exceeded (50K)"),
    ),
    "permissive": (
        REVERSE,
        Rule("block-base64-exec", "deny", SHELL, {"command": r"base64.*\|.*(eval|exec|sh|bash|python)"}, reason="Encoded execution pattern blocked"),
        Rule("block-credential-exfil", "deny", SHELL, {"command": r"curl.*(/etc/passwd|/etc/shadow|\.ssh/|credentials)"}, reason="Credential exfiltration pattern blocked"),
    ),
}


def decide(calls: DataFrame, rules: tuple[Rule, ...], dry_run: bool = False) -> DataFrame:
    """calls (tool_name, arguments map, token_spent, call_chain) with decision, policy_matched and reason; the first rule wins."""
    tool, arguments, tokens, depth = F.col("tool_name"), F.col("arguments"), F.coalesce("token_spent", F.lit(0)), F.coalesce(F.size("call_chain"), F.lit(0))
    hit = F.coalesce(*[F.when(r.matches(tool, arguments, tokens, depth), F.struct(F.lit(r.action).alias("decision"), F.lit(r.name).alias("policy_matched"), F.lit(r.reason).alias("reason"))) for r in rules], F.struct(F.lit("allow").alias("decision"), F.lit(None).cast("string").alias("policy_matched"), F.lit("").alias("reason")))
    out = calls.withColumn("_hit", hit).select("*", "_hit.decision", "_hit.policy_matched", "_hit.reason").drop("_hit")
    if dry_run:  # what would have been denied is allowed, with its reason marked
        denied = F.col("decision") == "deny"
        out = out.withColumn("reason", F.when(denied, F.concat(F.lit("[dry-run] "), "reason")).otherwise(F.col("reason"))).withColumn("would_deny", denied).withColumn("decision", F.when(denied, "allow").otherwise(F.col("decision")))
    return out


def decide_by_table(calls: DataFrame, rules: DataFrame, key: str = "call_id", compiled: int = 1000) -> DataFrame:
    """The same for rules in a table (rule_order, name, action, tool_pattern). Up to `compiled` rules become one
    expression without a join; more are joined with the different tool names, of which there are fewer than calls."""
    listed = rules.orderBy("rule_order").limit(compiled + 1).collect()
    if len(listed) <= compiled:
        shape = lambda r: F.struct(F.lit(r["action"]).alias("action"), F.lit(r["name"]).alias("name"))
        none = F.lit(None).cast("struct<action:string,name:string>")
        out = calls.withColumn("hit", F.coalesce(*[F.when(F.col("tool_name").rlike(r["tool_pattern"]), shape(r)) for r in listed], none))
    else:
        names = calls.select("tool_name").distinct().join(rules, F.expr("tool_name rlike tool_pattern"))
        first = names.groupBy("tool_name").agg(F.min_by(F.struct("action", "name"), "rule_order").alias("hit"))
        out = calls.join(first, "tool_name", "left")
    return out.select(*[F.col(c) for c in calls.columns], F.coalesce("hit.action", F.lit("allow")).alias("decision"), F.col("hit.name").alias("policy_matched"))


def server_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls with the action of the first rule (o, p, action) that is their tool's name, or ends in * and begins it; null
    without one. Different tool names meet rules by equal texts: the name, and each of its beginnings with a star."""
    names = calls.select("tool_name").distinct().where("tool_name is not null")
    begin = F.transform(F.sequence(F.lit(0), F.length("tool_name")), lambda n: F.concat(F.left(F.col("tool_name"), n), F.lit("*")))
    asked = names.select("tool_name", F.explode(F.array_append(begin, F.col("tool_name"))).alias("p"))
    first = asked.join(rules, "p").groupBy("tool_name").agg(F.min_by("action", "o").alias("action"))
    return calls.join(first, "tool_name", "left").select(*[F.col(c) for c in calls.columns], "action")


def as_of(calls: DataFrame, scores: DataFrame, ttl_hours: int) -> DataFrame:
    """calls (tool_name, ts) with the score, and whatever else scores (tool_name, fetched_at, score) hold as `found`, that
    was fetched last before them and isn't older than the ttl.

    Both sides meet by tool and hour: inside of an hour a window finds the last one, and of the hours before only their
    last scores count, so a tool with many calls or scores is spread over its hours. At equal times the score comes first;
    of scores with one time the largest row holds.
    """
    hour = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 3600)
    s = scores.select("tool_name", hour("fetched_at").alias("_h"), F.col("fetched_at").cast("timestamp").alias("_at"), F.struct("fetched_at", *[c for c in scores.columns if c not in ("tool_name", "fetched_at")]).alias("_s"))
    c = calls.select("tool_name", hour("ts").alias("_h"), F.col("ts").cast("timestamp").alias("_at"), F.struct(*[F.col(f"`{x}`") for x in calls.columns]).alias("_c"))
    none = lambda kind: F.lit(None).cast(kind)
    both = s.withColumn("_c", none(c.schema["_c"].dataType)).unionByName(c.withColumn("_s", none(s.schema["_s"].dataType)))
    inside = Window.partitionBy("tool_name", "_h").orderBy("_at", F.col("_c").isNotNull(), "_s").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_in", F.last("_s", ignorenulls=True).over(inside)).where("_c is not null").select("tool_name", "_h", "_c", "_in")
    # a row per tool and hour that has scores or calls
    hours = both.groupBy("tool_name", "_h").agg(F.max("_s").alias("_s"))
    earlier = Window.partitionBy("tool_name").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("tool_name", "_h", F.last("_s", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    out = rows.join(hours, ["tool_name", "_h"], "left").select("_c", F.coalesce("_in", "_before").alias("found"))
    young = F.col("_c.ts") < F.col("found.fetched_at") + F.expr(f"interval {ttl_hours} hours")
    return out.select("_c.*", F.when(young, F.col("found")).alias("found"))


def trust_gate(calls: DataFrame, scores: DataFrame, mode: str = "balanced", ttl_hours: int = 24) -> DataFrame:
    """calls (tool_name, ts, and if there: decision of the policy, secret_found) with the latest score not older than the
    ttl and the gate: block, redact or allow.

    A malicious tool (verdict of scores, if there) or a score below 3 blocks, as does a denied call; an escalated one and a
    tool without a score block in strict mode only. Secrets among the arguments block in strict mode, else are redacted.
    """
    strict = F.lit(mode == "strict")
    named = calls.where("tool_name is not null")
    found = as_of(named, scores, ttl_hours).unionByName(calls.where("tool_name is null").withColumn("found", F.lit(None).cast(as_of(named, scores, ttl_hours).schema["found"].dataType)))
    known = F.col("found").isNotNull()
    bad = F.col("found.score") < 3
    bad = bad | (F.col("found.verdict") == "malicious") if "verdict" in scores.columns else bad
    cases = [(bad, "block"), (~known & strict, "block")]
    if "decision" in calls.columns:
        cases += [(F.col("decision") == "deny", "block"), ((F.col("decision") == "escalate") & strict, "block")]
    if "secret_found" in calls.columns:
        cases += [(F.col("secret_found") & strict, "block"), (F.col("secret_found"), "redact")]
    gate = F.coalesce(*[F.when(c, F.lit(x)) for c, x in cases], F.lit("allow"))
    return found.select(*calls.columns, F.col("found.score").alias("score"), gate.alias("gate"))
