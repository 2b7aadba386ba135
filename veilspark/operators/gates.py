"""Gates for proposed texts: rewritten descriptions and suggested fixes, with reasons against them and hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators import tools

# Phrases that say nothing, words without weight, what shows each criterion, and words of each fix category.
EMPTY = (r"Unlike \w+,? this tool specifically", "verify the path is within allowed directories", "Check file permissions if access is denied", r"Ensure (?:the |that )?\w+ (?:is|are) valid before")
SMALL = ("the", "a", "an", "to", "for", "of", "in", "on", "by", "with", "from", "this")
PLAIN = ("the", "and", "for", "with", "from", "that", "this", "all", "are", "has", "have", "been", "will", "can", "does", "not", "was", "were")
ERRORS = "(?i)error|fail|common issue|if .* fails|troubleshoot|raise|exception|invalid"
PARAMS = r"(?i)(?:param(?:eter)?s?|input|argument|accepts?|takes?|requires?|expects?)\s*[:.)]\s|`\w+`|--\w+"
APART = r"(?i)do not use when|avoid (?:this )?when|not (?:intended|designed) for|prefer .+? instead|use .+? instead(?:\b|[.,])"
FILLER_FIX = (r"^(fix|update|change|modify) (the|this) (code|file|issue)\.?$", "^consider (fixing|updating|changing)", "^TODO")
FIX_WORDS = {
    "credential": ("env", "secret", "key", "credential", "password", "token", "environ"),
    "path_traversal": ("path", "resolve", "relative", "directory", "traversal", "sanitize"),
    "sql_injection": ("parameterize", "placeholder", "prepared", "bind", "sql", "query"),
    "truncation": ("limit", "truncat", "max", "bound", "pagina"),
    "read_only": ("read", "only", "readonly", "write", "delete", "insert", "update"),
}


def _criteria(text: Column) -> dict[str, tuple[Column, float]]:
    first = F.regexp_replace(F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1)), "s+$", "")
    verb = F.arrays_overlap(F.array(first, F.regexp_replace(first, "e+$", "")), F.array(*map(F.lit, tools.VERBS)))
    return {
        "action_verb": (verb, 1.5), "scenario": (text.rlike(tools.SCENARIO), 3.0), "param_docs": (text.rlike(PARAMS), 1.5),
        "examples": (text.rlike(tools.EXAMPLES), 1.5), "error_guidance": (text.rlike(ERRORS), 1.0), "disambiguation": (text.rlike(APART), 1.0),
    }


def quick_score(text: Column) -> Column:
    """A description's score without its siblings, 0 to 10."""
    points = reduce(Column.__add__, [F.when(c, w).otherwise(0.0) for c, w in _criteria(text).values()])
    return F.bround(F.least((points + tools.length_step(text) * 0.5) * tools.density(text), F.lit(10.0)), 1)


def missing(text: Column, enough: float = 9.8) -> Column:
    """Criteria that a description lacks; none where its score is enough; an empty one lacks its text."""
    lacks = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, (c, _) in _criteria(text).items()]))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array(F.lit("text"))).when(quick_score(text) >= enough, F.array().cast("array<string>")).otherwise(lacks)


def gated_rewrites(pairs: DataFrame) -> DataFrame:
    """pairs (tool_name, description, rewritten) with rejected (the first reason, null if accepted), accepted text and its score.

    Null texts count as empty; an empty rewrite is no improvement.
    """
    old, new = F.coalesce("description", F.lit("")), F.coalesce("rewritten", F.lit(""))
    words = F.filter(F.split(new, r"\s+"), lambda w: w != "")
    body = F.regexp_extract(new, r"(?i)Use when the user wants to (.+?)\.(?:\s|$)", 1)
    told = F.filter(F.split(F.lower(body), r"\s+"), lambda w: w != "")
    small = F.array(*map(F.lit, SMALL))
    name = F.array_except(F.filter(F.split(F.lower(F.coalesce("tool_name", F.lit(""))), "[-_]"), lambda w: w != ""), small)
    trigger = F.array_except(told, small)
    nouns = lambda c: F.array_except(F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z]\w{2,}"), F.lit(0)), F.array(*map(F.lit, PLAIN)))
    kept = F.size(F.array_intersect(nouns(old), nouns(new))) / F.size(nouns(old))
    before, after = quick_score(old), quick_score(new)
    start, end = F.left(new, F.lit(1)), F.right(new, F.lit(1))
    reason = (
        F.when(old == new, "identical")
        .when((new != "") & ((F.upper(start) != start) | (F.lower(start) == start)), "starts with lowercase")
        .when((new != "") & ~end.isin(*".!?)\"'"), "does not end with punctuation")
        .when((F.size(words) >= 2) & (F.lower(F.try_element_at(words, F.lit(1))) == F.lower(F.try_element_at(words, F.lit(2)))), "repeated word")
        .when(reduce(Column.__or__, [new.rlike("(?i)" + x) for x in EMPTY]), "tautological pattern")
        .when((body != "") & (F.size(told) <= 3), "tautological trigger")
        .when((body != "") & (F.size(name) > 0) & (F.size(trigger) > 0) & (F.size(F.array_except(trigger, name)) == 0), "trigger restates tool name")
        .when((F.size(nouns(old)) >= 3) & (kept < 0.3), "lost key nouns")
        .when(F.length(new) > 1500, "too long")
        .when(after <= before, "no score improvement")
    )
    out = pairs.withColumn("rejected", reason)
    return out.withColumn("accepted", F.when(F.col("rejected").isNull(), F.col("rewritten")).otherwise(F.col("description"))).withColumn("score", F.when(F.col("rejected").isNull(), after).otherwise(before))


def unknown_references(descriptions: DataFrame, siblings: DataFrame) -> DataFrame:
    """server, tool_name, reference: tools that a description sends to ("use X instead") but its server (server, sibling) hasn't."""
    refs = descriptions.select("server", "tool_name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"use\s+(\w+)\s+instead"), F.lit(1)))).alias("reference"))
    names = siblings.select("server", F.lower("sibling").alias("reference")).distinct()
    return refs.join(names, ["server", "reference"], "left_anti").select("server", "tool_name", "reference")


def gated_fixes(fixes: DataFrame) -> DataFrame:
    """fixes (category, original, suggestion, code) with rejected (null if accepted), confidence (null if rejected) and hints."""
    told, code, original = F.coalesce("suggestion", F.lit("")), F.trim(F.coalesce("code", F.lit(""))), F.coalesce("original", F.lit(""))
    lines = lambda c: F.array_distinct(F.split(F.trim(c), "\r?\n"))
    kept = F.size(F.array_intersect(lines(original), lines(code))) / F.size(lines(original))
    compared = (code != "") & (original != "")
    low = F.lower(told)
    fits = F.coalesce(*[F.when(F.col("category") == c, low.rlike("|".join(ws))) for c, ws in FIX_WORDS.items()], F.lit(False))
    reason = (
        F.when(F.trim(told) == "", "empty suggestion")
        .when(reduce(Column.__or__, [F.trim(told).rlike("(?i)" + x) for x in FILLER_FIX]), "generic filler suggestion")
        .when((code != "") & (F.length(code) < 10), "code fix too short")
        .when(code.startswith("# ") & ~code.contains("\n"), "code fix is just a comment")
        .when(compared & (kept < 0.1) & (F.size(lines(original)) > 3), "code fix removes too much")
    )
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    sure = 0.5 + one(fits, 0.2) + one(code.rlike(r"import |def |class |if |for |return |=\s|\.|\("), 0.2) + F.when(compared, F.least(F.lit(0.1), kept * 0.2)).otherwise(0.0)
    is_ = lambda c: F.col("category") == c
    hints = [(code == "", "code"), (~low.rlike("before|after"), "before and after"), (is_("credential") & ~low.contains("env"), "environment variable"), (is_("sql_injection") & ~code.rlike("[?$]"), "parameterized query"), (is_("path_traversal") & ~F.lower(code).contains("resolve"), "path resolution")]
    out = fixes.withColumn("rejected", reason)
    return out.withColumn("confidence", F.when(F.col("rejected").isNull(), F.bround(F.least(F.lit(1.0), sure), 2))).withColumn("hints", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in hints])))


def confirmed_keywords(tools: DataFrame, rules: DataFrame) -> DataFrame:
    """server, tool_name, keyword, value: rules (keyword, signals, value) whose keyword stands in a tool's name and one of whose
    signals stands in a name of the same server; the first rule of a tool by its order (rule_order). Rules are a short list:
    names and signals meet inside of a server's own collected names."""
    low = tools.select("server", "tool_name", F.lower("tool_name").alias("_low"))
    listed = rules.select("rule_order", "keyword", "signals", "value").orderBy("rule_order").collect()
    all_names = low.groupBy("server").agg(F.array_join(F.array_sort(F.collect_set("_low")), " ").alias("_names"))  # a server's tools
    holds = lambda r: F.col("_low").contains(r["keyword"]) & reduce(Column.__or__, [F.col("_names").contains(x) for x in r["signals"]], F.lit(False))
    none = F.lit(None).cast("struct<keyword:string,value:string>")
    first = F.coalesce(*[F.when(holds(r), F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(r["value"]).alias("value"))) for r in listed], none)
    return low.join(all_names, "server").select("server", "tool_name", first.alias("_r")).where("_r is not null").select("server", "tool_name", "_r.*")


def patched(sources: DataFrame) -> DataFrame:
    """sources (content, tool_name, original, rewritten) with the proposed content and patched: the first place of the original
    description behind the tool's name, or else its only place, takes the rewritten one, with quotes, backslashes and line
    ends escaped where the original stands in quotes. Nothing is written in place; other contents stay."""
    content, old = F.col("content"), F.col("original")
    at_name = F.call_function("instr", content, F.col("tool_name"))
    behind = F.call_function("locate", old, content, F.greatest(at_name, F.lit(1)))
    once = (F.length(content) - F.length(F.replace(content, old, F.lit("")))) == F.length(old)
    place = F.when((at_name > 0) & (behind > 0), behind).when(once, F.call_function("instr", content, old))
    place = F.when(F.coalesce(F.length(old) > 0, F.lit(False)), place)
    quote = F.substring(content, place - 1, F.lit(1))
    plain = F.replace(F.replace(F.col("rewritten"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    shaped = F.when(quote == '"', F.replace(plain, F.lit('"'), F.lit('\\"'))).when(quote == "'", F.replace(plain, F.lit("'"), F.lit("\\'"))).otherwise(F.col("rewritten"))
    new = F.concat(F.left(content, place - 1), shaped, F.substring(content, place + F.length(old), F.length(content)))
    return sources.withColumn("patched", place.isNotNull()).withColumn("proposed", F.when(place.isNotNull(), new).otherwise(content))
