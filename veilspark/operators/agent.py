"""Agents and skills: allowlists, pins, look-alike names, capabilities and toxic flows, licences, configuration, risk classes."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as p

# Name classes of tools, licences, and keys in configurations.
RISK = (
    ("destructive", "deny", r"(?:^|[-_])(delete|remove|drop|destroy|purge|clear|reset|revoke|terminate|kill|truncate)(?:[-_]|$)"),
    ("write", "allow", r"(?:^|[-_])(create|update|write|set|put|insert|add|post|send|push|upload|save|modify|edit|patch)(?:[-_]|$)"),
    ("read", "allow", r"(?:^|[-_])(get|list|read|search|find|fetch|query|lookup|check|show|describe|count|browse|view|export)(?:[-_]|$)"),
)
PERMISSIVE, COPYLEFT = ("mit", "apache-2.0", "apache 2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense"), ("gpl", "agpl", "lgpl")
KEYS = (("Anthropic API key", r"sk-ant-[a-zA-Z0-9_-]{20,}"), ("OpenAI API key", r"sk-[a-zA-Z0-9]{20,}"), ("Groq API key", r"gsk_[a-zA-Z0-9]{20,}"), ("xAI API key", r"xai-[a-zA-Z0-9]{20,}"))


def not_allowed(skills: DataFrame, allowlist: DataFrame, key: str = "skill_name") -> DataFrame:
    return skills.join(allowlist, key, "left_anti")


def content_hash(content: Column) -> Column:
    """SHA-256 of the content without white space at its end."""
    return F.sha2(F.regexp_replace(content, r"(?U)\s+\z", ""), 256)


def verified(skills: DataFrame, pins: DataFrame) -> DataFrame:
    """skill_name and its status: safe, tampered, or unknown without a pin. Of several pins the last holds."""
    last = pins.groupBy("skill_name").agg(F.max_by("hash", "pinned_at").alias("hash"))
    status = F.when(F.col("hash").isNull(), "unknown").when(F.col("hash") == content_hash(F.col("content")), "safe").otherwise("tampered")
    return skills.join(last, "skill_name", "left").select("skill_name", status.alias("status"))


def look_alikes(names: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """Names at 1 to `most` edits from a target. Both meet by the length of the name; which side is sent is left to sizes."""
    near = F.levenshtein("skill_name", "target", most)
    reach = targets.select("target", F.explode(F.sequence(F.length("target") - most, F.length("target") + most)).alias("_n"))
    met = names.withColumn("_n", F.length("skill_name")).join(reach, "_n").withColumn("distance", near)
    return met.where(F.col("distance").between(1, most)).select("skill_name", "target", "distance")


def _stands(low: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text in lower case; one that opens with a word is tried only where that word stands."""
    word = re.match(r"\\b([a-z]+)", phrase)
    return low.contains(word[1]) & low.rlike(phrase) if word else low.rlike(phrase)


def capabilities(low: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """Labels of the phrases that stand in the text (in lower case), each once, in their order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(_stands(low, x), F.lit(label)) for x, label in phrases])))


def flows_of(low: Column) -> Column:
    """exfiltration: a source and a sink in one text (in lower case); destructive: a source and destruction. A null text has none."""
    any_of = lambda phrases: reduce(Column.__or__, [_stands(low, x) for x, _ in phrases])
    reads = any_of(p.TEXT_SOURCES)
    return F.array_compact(F.array(F.when(any_of(p.TEXT_SINKS) & reads, F.lit("exfiltration")), F.when(any_of(p.TEXT_DESTRUCTIVE) & reads, F.lit("destructive"))))


def toxic_flows(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with labels of sources, sinks and destructive phrases, and the flows they make."""
    low = F.col("_low")
    found = docs.withColumn("_low", F.lower(text_col)).withColumn("_x", F.explode(F.array(F.struct(capabilities(low, p.TEXT_SOURCES).alias("sources"), capabilities(low, p.TEXT_SINKS).alias("sinks"), capabilities(low, p.TEXT_DESTRUCTIVE).alias("destructive")))))
    has = lambda c: F.size(f"_x.{c}") > 0
    flows = F.array_compact(F.array(F.when(has("sources") & has("sinks"), F.lit("exfiltration")), F.when(has("sources") & has("destructive"), F.lit("destructive"))))
    return found.withColumns({"sources": F.col("_x.sources"), "sinks": F.col("_x.sinks"), "destructive": F.col("_x.destructive"), "flows": flows}).drop("_low", "_x")


def license_of(text: Column) -> Column:
    """The licence that a licence file's text is, the first that holds; null only for a null text."""
    low = F.lower(text)
    has = lambda *xs: [low.contains(x) for x in xs]
    mit, free, apache, version, bsd, again, gnu, gpl = has("mit license", "permission is hereby granted, free of charge", "apache license", "version 2.0", "bsd", "redistribution", "gnu general public license", "gpl")
    lesser, lgpl, affero, agpl, isc, un, public = has("lesser", "lgpl", "affero", "agpl", "isc license", "unlicense", "public domain")
    family = F.when(lesser | lgpl, "LGPL").when(affero | agpl, "AGPL").otherwise("GPL")
    named = F.when(mit | free, "MIT").when(apache & version, "Apache-2.0").when(bsd & again, "BSD").when(gnu | gpl, family).when(isc, "ISC").when(un | public, "Unlicense").otherwise("Unknown")
    return F.when(text.isNotNull(), named)


def is_permissive(license: Column) -> Column:
    return F.lower(F.trim(license)).isin(*PERMISSIVE, "bsd")


def licenses(files: DataFrame) -> DataFrame:
    """target, license, permissive from files (target, path relative to the target, content).

    The first of: a licence file, package.json, a licence file of a folder above (path ../ and so on, the nearest),
    pyproject.toml. Targets without any have none and aren't permissive.
    """
    path, text = F.col("path"), F.col("content")
    up, name = F.size(F.regexp_extract_all("path", F.lit(r"(?:^|/)\.\."), F.lit(0))), F.element_at(F.split(path, "/"), -1)
    place = F.array_position(F.array(*map(F.lit, ("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING"))), name)
    manifest = F.get_json_object("content", "$.license")
    line = F.regexp_extract("content", r"(?im)^[^\n=]*license[^\n=]*=\s*[\"']?([^\"'\n]*)", 1)
    value = F.when(place > 0, license_of(text)).when((path == "package.json") & ~F.lower(manifest).contains("see license"), F.nullif(manifest, F.lit(""))).when(path == "pyproject.toml", F.nullif(F.trim(line), F.lit("")))
    order = F.when((place > 0) & (up == 0), F.struct(F.lit(0), place)).when(path == "package.json", F.struct(F.lit(1), place)).when(place > 0, F.struct(1 + up, place)).otherwise(F.struct(F.lit(1000000), place))
    best = files.groupBy("target").agg(F.min_by(value, F.when(value.isNotNull(), order)).alias("license"))
    return best.withColumn("permissive", F.coalesce(is_permissive(F.col("license")), F.lit(False)))


def risk_class(name: Column, critical: Column | None = None, score: Column | None = None) -> tuple[Column, Column]:
    """Category and decision of a tool by its name, its server's critical issues and its description's score."""
    low = F.lower(name)
    (_, _, destroys), (_, _, writes), (_, _, reads) = RISK
    critical, score = critical if critical is not None else F.lit(False), score if score is not None else F.lit(10.0)
    cases = ((low.rlike(destroys), "destructive", "deny"), (low.rlike(writes) & critical, "write", "escalate"), (score < 3.0, "low-quality", "escalate"), (low.rlike(writes), "write", "allow"), (low.rlike(reads), "read", "allow"))
    return F.coalesce(*[F.when(c, F.lit(k)) for c, k, _ in cases], F.lit("unknown")), F.coalesce(*[F.when(c, F.lit(d)) for c, _, d in cases], F.lit("allow"))


def generated_policies(tools: DataFrame) -> DataFrame:
    """server and its policy as a document: a rule per tool (server, tool_name, critical, score), by name. A server's tools are few."""
    category, decision = risk_class(F.col("tool_name"), F.coalesce("critical", F.lit(False)), F.coalesce("score", F.lit(10.0)))
    rule = F.concat(F.lit('  - tool: "'), "tool_name", F.lit('"\n    decision: '), decision, F.lit("\n    category: "), category)
    rules = tools.select("server", "tool_name", rule.alias("rule")).groupBy("server").agg(F.array_sort(F.collect_set(F.struct("tool_name", "rule"))).alias("r"))
    return rules.select("server", F.concat(F.lit("server: "), "server", F.lit("\nrules:\n"), F.array_join(F.transform("r", lambda x: x["rule"]), "\n"), F.lit("\n")).alias("policy"))


def issue_code(name: Column) -> Column:
    """The code of a pattern or check, null where it has none."""
    return F.coalesce(*[F.when(name == n, F.lit(c)) for n, c in p.CODES.items()])


def ignored_names(wanted: list[str]) -> set[str]:
    """Names meant by a list of codes and names; unknown ones mean nothing."""
    named = {c: n for n, c in p.CODES.items()}
    return {named.get(w.strip(), w.strip()) for w in wanted} & set(p.CODES)


def coded(findings: DataFrame, column: str, ignored: list[str] | None = None) -> DataFrame:
    """findings with their code, less those ignored by code or name."""
    out = findings.withColumn("code", issue_code(F.col(column)))
    names = ignored_names(ignored or [])
    return out.where(~F.coalesce(F.col(column).isin(*names), F.lit(False))) if names else out


def verdict_counts(scanned: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Per agent its skills by verdict, and the exit code of a check: 2 if tampered, 1 if malicious (strict: or suspicious), else 0."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    bad = n("malicious") + n("suspicious") if strict else n("malicious")
    code = F.when(n("tampered") > 0, 2).when(bad > 0, 1).otherwise(0)
    return scanned.groupBy(key).agg(F.count("*").alias("skills"), n("safe").alias("safe"), n("suspicious").alias("suspicious"), n("malicious").alias("malicious"), code.alias("exit_code"))


def exit_codes(results: DataFrame, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """results (score, tampered, critical, findings) with exit_code: 2 if tampered; 1 if anything critical was found, in strict
    mode anything at all, or the score is below the threshold; else 0."""
    low = F.col("score") < threshold if threshold is not None else F.lit(False)
    bad = (F.col("critical") > 0) | (F.lit(strict) & (F.col("findings") > 0)) | low
    return results.withColumn("exit_code", F.when(F.col("tampered") > 0, 2).when(F.coalesce(bad, F.lit(False)), 1).otherwise(0))


def current_pins(changes: DataFrame) -> DataFrame:
    """skill_name, hash, pinned_at: the last change (skill_name, hash, pinned_at) of each skill, those unpinned (null hash) left out."""
    last = changes.groupBy("skill_name").agg(F.max_by(F.struct("hash", "pinned_at"), "pinned_at").alias("x"))
    return last.select("skill_name", "x.*").where("hash is not null")


def config_findings(configs: DataFrame) -> DataFrame:
    """agent, check_id, severity, fixable: the checks that a configuration (JSON text) fails, at most one of each kind.

    Column dir_mode, if there, holds the folder's permission bits. Null and texts that aren't an object give one finding.
    """
    at = lambda x: F.get_json_object("config", x)
    found = lambda cases: F.coalesce(*[F.when(c, F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), F.lit(f).alias("fixable"))) for c, i, s, f in cases])
    true = lambda x: ~F.coalesce(F.lower(at(x)), F.lit("false")).isin("false", "0", "", "null", "[]", "{}")
    bind, mode, auth, sandbox = F.coalesce(at("$.gateway.bind"), F.lit("loopback")), at("$.gateway.auth.mode"), at("$.gateway.auth"), at("$.agents.defaults.sandbox")
    channels = F.filter(F.map_values(F.coalesce(F.from_json(at("$.channels"), "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda c: F.get_json_object(c, "$.dmPolicy") == "open")
    first = F.try_element_at(channels, F.lit(1))
    full, deny = at("$.tools.profile") == "full", F.coalesce(at("$.tools.deny"), F.lit("[]"))
    short = lambda x, n: F.length(F.coalesce(at(x), F.lit(""))) < n
    kinds = [
        [(bind == "lan", "gateway.bind", "high", True), (~bind.isin("loopback", "tailnet"), "gateway.bind", "critical", True)],
        [(auth.isNull(), "gateway.no_auth", "critical", True), ((mode == "token") & short("$.gateway.auth.token", 16), "gateway.weak_token", "high", True), ((mode == "password") & short("$.gateway.auth.password", 12), "gateway.weak_password", "high", False)],
        [(F.col("config").rlike("|".join(x for _, x in KEYS)), "config.plaintext_keys", "high", True)],
        [(sandbox.isNull(), "sandbox.not_configured", "high", True), (F.coalesce(at("$.agents.defaults.sandbox.mode"), F.lit("off")) == "off", "sandbox.disabled", "high", True), (at("$.agents.defaults.sandbox.workspaceAccess") == "rw", "sandbox.workspace_rw", "medium", False)],
        [(first.isNotNull() & F.coalesce(F.get_json_object(first, "$.allowFrom").contains('"*"'), F.lit(False)), "channels.open_dm", "high", True), (first.isNotNull(), "channels.open_dm", "medium", False)],
        [(full & deny.isin("[]", "", "{}"), "tools.full_no_deny", "high", True), (full, "tools.full_profile", "medium", False)],
        [(true("$.tools.elevated.enabled"), "tools.elevated", "high", True)],
        [(true("$.browser.ssrfPolicy.dangerouslyAllowPrivateNetwork"), "browser.ssrf", "high", True)],
        [(at("$.logging.redactSensitive").isin("false", "off"), "logging.redact_off", "medium", True)],
    ]
    if "dir_mode" in configs.columns:
        kinds.append([(F.col("dir_mode").bitwiseAND(6) > 0, "fs.permissions", "critical", True)])
    unreadable = F.coalesce(F.schema_of_variant(F.expr("try_parse_json(config)")), F.lit("")).startswith("OBJECT") == F.lit(False)
    broken = F.array(found([(F.col("config").isNull(), "config.not_found", "high", False), (F.lit(True), "config.parse_error", "medium", False)]))
    return configs.select("agent", F.explode(F.when(unreadable, broken).otherwise(F.array_compact(F.array(*map(found, kinds))))).alias("f")).select("agent", "f.*")


def proposed_configs(configs: DataFrame, token: str) -> DataFrame:
    """agent, config, proposed, moved: each readable configuration with its fixable findings set right; nothing is written in place.

    `token` is the caller's fresh secret of 32 characters or more, put where one is missing or weak. `moved` names the
    keys to be kept in the environment. Unreadable configurations stay as they are.
    """
    if len(token) < 32:
        raise ValueError("the token must have 32 characters or more")
    found = config_findings(configs).where("fixable").groupBy("agent").agg(F.collect_set("check_id").alias("_checks"))
    edit = {
        "gateway.bind": (("gateway", "bind"), "loopback"), "gateway.no_auth": (("gateway", "auth"), {"mode": "token", "token": token}), "gateway.weak_token": (("gateway", "auth", "token"), token),
        "sandbox.not_configured": (("agents", "defaults", "sandbox"), {"mode": "all", "scope": "agent", "workspaceAccess": "ro"}), "sandbox.disabled": (("agents", "defaults", "sandbox"), {"mode": "all", "scope": "agent", "workspaceAccess": "ro"}),
        "tools.full_no_deny": (("tools", "deny"), ["group:automation", "group:runtime"]), "tools.elevated": (("tools", "elevated", "enabled"), False), "browser.ssrf": (("browser", "ssrfPolicy", "dangerouslyAllowPrivateNetwork"), False),
        "logging.redact_off": (("logging", "redactSensitive"), True),
    }

    @F.pandas_udf("string")
    def fixed(config: pd.Series, checks: pd.Series) -> pd.Series:
        import json

        def one(text, ids):
            if text is None or ids is None or not len(ids):
                return text
            data = json.loads(text)
            for check in sorted(ids):
                if check in edit:
                    (*above, last), value = edit[check]
                    node = data
                    for k in above:
                        node[k] = node[k] if isinstance(node.get(k), dict) else {}
                        node = node[k]
                    node[last] = value
                elif check == "channels.open_dm":
                    for c in data["channels"].values():
                        if isinstance(c, dict) and c.get("dmPolicy") == "open":
                            c["dmPolicy"] = "pairing"
                elif check == "config.plaintext_keys" and isinstance(data.get("provider"), dict):
                    data["provider"].pop("apiKey", None)
            return json.dumps(data, ensure_ascii=False)

        return pd.Series([one(a, b) for a, b in zip(config, checks)], dtype="object")

    moved = F.array_compact(F.array(*[F.when(F.col("config").rlike(x), F.lit(n)) for n, x in KEYS]))
    return configs.join(found, "agent", "left").select("agent", "config", fixed("config", "_checks").alias("proposed"), moved.alias("moved"))
