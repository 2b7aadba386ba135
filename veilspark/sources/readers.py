"""Sources and sinks: audit logs, tool lists, source trees, configurations, policies; dated logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import let
from veilspark.operators.policy import Rule

AUDIT = "timestamp string, phase string, session_id string, agent_id string, tool_name string, call_index int, decision string, reason string, policy_matched string, arguments_summary string, pii_detected array<string>, latency_ms double, _corrupt_record string"


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of all files; blank and malformed lines are left out."""
    lines = spark.read.text(folder, pathGlobFilter="*.jsonl").where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", AUDIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def append_audit(log: DataFrame, folder: str) -> None:
    """Appends, a folder per day."""
    log.withColumn("date", F.substring("timestamp", 1, 10)).write.partitionBy("date").mode("append").json(folder)


def tools(spark: SparkSession, path: str) -> DataFrame:
    """name, description of each tool, from {"tools": [...]} or a plain list; a rewritten or original text stands in."""
    text = spark.read.text(path, wholetext=True)
    entry = "array<struct<name:string,description:string,rewritten:string,original:string>>"
    listed = F.coalesce(F.from_json("value", f"struct<tools:{entry}>")["tools"], F.from_json("value", entry))
    some = [F.when(F.col(f"t.{c}") != "", F.col(f"t.{c}")) for c in ("description", "rewritten", "original")]
    return text.select(F.explode(listed).alias("t")).select("t.name", F.coalesce(*some, F.lit("")).alias("description"))


def source_tree(spark: SparkSession, folder: str, extensions: str = "py,ts,js", excluded: str = "node_modules,.git,dist,build,__pycache__,venv") -> DataFrame:
    """path, ext, content of source files outside excluded folders."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{{{extensions}}}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    parts = F.split("path", "/")
    return files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, excluded.split(","))))).select("path", F.substring_index("path", ".", -1).alias("ext"), "content")


#: Strings in either quotes, comments, names, numbers, white space, and any other character: a lenient text in tokens.
TOKEN = r""""[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|//[^\n]*+|/\*[\s\S]*?\*/|[A-Za-z_$][\w$]*+|[-+.0-9][\w.+-]*+|\s++|[\s\S]"""


def plain_json(text: Column) -> Column:
    """JSON from a text that may hold comments, single quotes, bare names as keys, commas before a closing bracket, and
    numbers with a plus, a bare point or in hexadecimal. What stands in strings is kept; valid JSON is kept as it is."""
    double = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r"\\'", "'"), r'((?:^|[^\\])(?:\\\\)*)"', r'$1\\"'), F.lit('"'))

    def number(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\+", ""), r"^(-?)\.", "$10."), r"\.(?=$|[eE])", ".0")
        return F.when(x.rlike("^[-+]?0[xX][0-9a-fA-F]+$"), F.conv(F.regexp_replace(x, "^[-+]?0[xX]", ""), 16, 10)).otherwise(bare)

    def shaped(t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after, before = F.coalesce(F.try_element_at(t, i + 2), F.lit("")), F.coalesce(F.try_element_at(t, F.when(i > 0, i)), F.lit(""))
            return (
                F.when((x == ",") & after.isin("}", "]") & ~before.isin("{", "[", ",", ""), "")
                .when(x.startswith("'"), double(x))
                .when(x.rlike("^[A-Za-z_$]") & (after == ":"), F.concat(F.lit('"'), x, F.lit('"')))
                .when(x.rlike("^[-+.0-9]"), number(x))
                .otherwise(x)
            )

        return F.array_join(F.transform(t, one), "")

    tokens = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: ~x.startswith("//") & ~x.startswith("/*") & (F.trim(F.regexp_replace(x, r"\s", "")) != ""))
    return F.when(F.call_function("try_parse_json", text).isNotNull(), text).otherwise(let(tokens, shaped))


def configs(spark: SparkSession, path: str) -> DataFrame:
    """agent (file path) and config: lenient JSON made plain."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("agent"), F.col("value").alias("config"))
    return text.withColumn("config", plain_json(F.col("config")))


def _loaded(text: str):
    """A document in YAML, or in JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def policy_errors(text: str) -> list[str]:
    """All that is wrong with a policy file, by rule; none if it's valid."""
    data = _loaded(text)
    if not isinstance(data, dict) or "policies" not in data:
        return ["no policies at the top"]
    if not isinstance(data["policies"], list):
        return ["policies isn't a list"]
    errors = []
    for n, rule in enumerate(data["policies"], 1):
        if not isinstance(rule, dict):
            errors.append(f"rule {n}: not a mapping")
            continue
        match = rule.get("match") or {}
        tests = (("name" not in rule, "no name"), ("action" not in rule, "no action"), (rule.get("action", "deny") not in ("allow", "deny", "escalate"), f"unknown action {rule.get('action')!r}"), (not (match.get("tool") or match.get("any_tool")), "matches no tool"))
        errors += [f"rule {n}: {message}" for bad, message in tests if bad]
    return errors


def skills(spark: SparkSession, folder: str) -> DataFrame:
    """skill_name, path, content of each SKILL.md in folder/skills and folder/workspace/skills, or in a folder of theirs.

    The name is that of the file's folder; of a file straight in skills, the file's without ending. Folders that aren't
    there hold none.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    inner = F.substring_index("path", re.sub("^[a-z]+:/*", "", folder).rstrip("/") + "/", -1)
    own = files.where(inner.rlike("^(?:workspace/)?skills/(?:[^/]+/)?SKILL[.]md$"))
    parent = F.element_at(F.split("path", "/"), -2)
    return own.select(F.when(parent == "skills", "SKILL").otherwise(parent).alias("skill_name"), "path", "content")


def _entries(spark: SparkSession, path: str, value: str, inside: str | None) -> DataFrame:
    """key and fields of each entry of a JSON object; none from a file that can't be read as one."""
    text = spark.read.text(path, wholetext=True).select((F.get_json_object("value", f"$.{inside}") if inside else F.col("value")).alias("value"))
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("skill_name", "_v")).select("skill_name", "_v.*")


def pins(spark: SparkSession, path: str) -> DataFrame:
    """skill_name, hash, pinned_at, path from a file of pins."""
    return _entries(spark, path, "hash:string,pinned_at:string,path:string", None)


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    """skill_name, approved_by, approved_at from a list of approved skills."""
    return _entries(spark, path, "approved_by:string,approved_at:string", "skills")


def generated_scenarios(tools: DataFrame) -> DataFrame:
    """intent, expected_tool for tools (tool_name, description) that no scenarios are given for: the first sentence of each description."""
    first = F.regexp_extract(F.trim("description"), r"^(.*?)(?:[.!?](?:\s|$)|\n|$)", 1)
    return tools.where(F.trim("description") != "").select(F.lower(first).alias("intent"), F.col("tool_name").alias("expected_tool"))


def scenarios(text: str) -> list[tuple[str, str]]:
    """intent, expected tool of each scenario in a file."""
    return [(x["intent"], x["expected_tool"]) for x in (_loaded(text) or {}).get("scenarios", [])]


def policy(text: str) -> tuple[Rule, ...]:
    """Rules of a policy file."""
    data = _loaded(text)
    rules = []
    for p in data.get("policies", []):
        match, condition = p.get("match", {}), p.get("condition", {})
        if p.get("action") not in ("allow", "deny", "escalate"):
            raise ValueError(f"rule {p.get('name')!r}: unknown action {p.get('action')!r}")
        rules.append(Rule(p.get("name", ""), p["action"], match.get("tool"), match.get("args_pattern", {}), bool(match.get("any_tool")), condition.get("token_spent_gt"), condition.get("chain_depth_gt"), p.get("reason", "")))
    return tuple(rules)
