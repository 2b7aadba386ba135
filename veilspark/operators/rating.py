"""Ratings of servers and skills: dimensions, security, metadata, and the rating document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions import scoring

DIMENSIONS = tuple(scoring.DESCRIPTION_WEIGHTS)
# Signs in a skill's text by dimension, with their points; the text is in lower case.
SIGNS = {
    "intent_clarity": ((r"this skill|this tool|purpose|designed to|helps? you|allows? you|enables?", 4.0),),
    "permission_scope": ((r"requires?:?|dependencies|prerequisites|requirements?:?", 4.0), (r"(read|write|access|modify)\s+(files?|directories|folders?)", 3.0)),
    "side_effects": ((r"undo|revert|rollback|backup", 3.0),),
    "capability_disclosure": ((r"example|e\.g\.|usage|demo|sample", 4.0), (r"limit|cannot|doesn.t|won.t|not supported|caveat", 3.0), (r"step\s+\d|1\.|first,|then,", 3.0)),
    "operational_boundaries": ((r"scope|boundary|boundaries|only\s+works|limited\s+to|specific\s+to", 4.0), (r"when\s+to\s+use|use\s+this\s+when|best\s+for|ideal\s+for", 3.0)),
}
EFFECTS = r"side.?effects?|modif|changes?|creates?\s+files?|writes?\s+to|deletes?|removes?|warning|caution"
FIRST_VERBS = r"\b(create|analyze|search|generate|debug|test|build|deploy|monitor|scan|fix)\b"


def _rounded(parts: dict[str, Column]) -> dict[str, Column]:
    """The dimensions and their composite, each to one place."""
    return {**{k: F.bround(c, 1) for k, c in parts.items()}, "composite": F.bround(scoring.weighted(parts, scoring.DESCRIPTION_WEIGHTS), 1)}


def description_dimensions(scores: DataFrame, servers: DataFrame) -> DataFrame:
    """Per server of `servers` five dimensions and their composite from its tools' criteria; all 5 without a tool."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    disambiguation, whole = F.avg(F.coalesce("disambiguation_score", F.lit(0.5))), F.avg(F.coalesce("overall_score", F.lit(5.0)))
    parts = {
        "intent_clarity": (share("has_action_verb") * 0.4 + share("has_scenario_trigger") * 0.6) * 10, "permission_scope": share("has_param_docs") * 10,
        "side_effects": F.least(F.lit(10.0), share("has_error_guidance") * 10 + 2), "capability_disclosure": (share("has_param_examples") * 0.6 + disambiguation * 0.4) * 10, "operational_boundaries": whole,
    }
    raw = scores.groupBy("server").agg(*[c.alias(k) for k, c in parts.items()])
    out = servers.select("server").distinct().join(raw, "server", "left").fillna(5.0, list(DIMENSIONS))
    return out.select("server", *[c.alias(k) for k, c in _rounded({k: F.col(k) for k in DIMENSIONS}).items()])


def skill_dimensions(text: Column) -> dict[str, Column]:
    """The same dimensions from a skill's own text."""
    low = F.lower(text)
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\r?\n")
    points = lambda c, w, other=0.0: F.when(c, w).otherwise(other)
    parts = {k: reduce(Column.__add__, [points(low.rlike(x), w) for x, w in signs]) for k, signs in SIGNS.items()}
    parts["intent_clarity"] += points(F.element_at(lines, 1).startswith("#"), 3.0) + points(F.lower(F.array_join(F.slice(lines, 1, 10), "\n")).rlike(FIRST_VERBS), 3.0)
    parts["permission_scope"] += points(text.rlike(r"bins:\s*\["), 3.0)
    parts["side_effects"] = F.least(F.lit(10.0), parts["side_effects"] + points(low.rlike(EFFECTS), 5.0, 2.0) + points(F.length(text) > 200, 2.0))
    parts["operational_boundaries"] += F.least(F.lit(3.0), F.length(text) / 500.0)
    return _rounded(parts)


def security(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Per server (server, security_score, architecture_score) the mapped security score, bonus and counts; what low issues cost is given back."""
    per = found.groupBy("server").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")])
    out = scores.join(per, "server", "left").fillna(0, [f"{s}_count" for s in ("critical", "high", "medium", "low")])
    return out.withColumn("score", F.bround(F.least(F.lit(10.0), F.col("security_score") + F.col("low_count") * 0.25), 1)).withColumn("architecture_bonus", F.bround(scoring.architecture_bonus(F.col("architecture_score")), 1)).drop("security_score", "architecture_score")


def metadata(repos: DataFrame, as_of: Column) -> DataFrame:
    """repos (stars, forks, last_commit text, description, license) with provenance, maintenance, popularity and composite at a time."""
    stars, forks = F.coalesce("stars", F.lit(0)), F.coalesce("forks", F.lit(0))
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    licensed = F.coalesce(~F.col("license").isin("", "NOASSERTION"), F.lit(False))
    provenance = F.least(F.lit(10.0), 5.0 + add(licensed, 2.0) + add(F.length("description") > 20, 1.5) + add(stars > 100, 1.0))
    days = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.try_to_timestamp("last_commit"))) / 86400)
    maintenance = F.coalesce(F.when(days < 30, 9.0).when(days < 90, 7.5).when(days < 180, 6.0).when(days < 365, 4.0).when(days >= 365, 2.0), F.lit(5.0))
    popularity = F.least(F.lit(10.0), scoring.step(stars, [(5000, 9.5), (1000, 8.0), (500, 7.0), (100, 6.0), (50, 5.0), (10, 3.5)], 2.0) + scoring.step(forks, [(100, 1.0), (20, 0.5)], 0.0))
    parts = {"provenance": provenance, "maintenance": maintenance, "popularity": popularity}
    return repos.withColumns({**{k: F.bround(c, 1) for k, c in parts.items()}, "composite": F.bround(scoring.weighted(parts, scoring.METADATA_WEIGHTS), 1)})


def documents(servers: DataFrame) -> DataFrame:
    """server and its rating as JSON from (server, description, security, metadata, critical_count, tool_count, license).

    A hard constraint sets the grade and caps the score: 2 for F, 4.9 for D.
    """
    constraint = scoring.hard_constraint(F.col("critical_count"), F.col("tool_count"), F.col("license"))
    base = servers.withColumn("_overall", scoring.overall(F.col("description"), F.col("security"), F.col("metadata"))).withColumn("hard_constraint", constraint)
    grade = scoring.constrained_grade(F.col("_overall"), F.col("hard_constraint"))
    cap = F.when(F.col("hard_constraint").isNull(), 10.0).when(grade == "F", 2.0).when(grade == "D", 4.9).otherwise(10.0)
    layers = F.struct("description", "security", "metadata")
    return base.select("server", F.to_json(F.struct("server", F.least("_overall", cap).alias("overall"), grade.alias("grade"), "hard_constraint", layers.alias("layers"), "tool_count", "license")).alias("rating"))


def local_overall(description: Column, security: Column, architecture: Column) -> Column:
    """A scan's own score of three layers; the architecture's bonus counts with security, up to 10."""
    lifted = F.least(F.lit(10.0), security + scoring.architecture_bonus(architecture))
    return F.bround(description * 0.35 + lifted * 0.35 + architecture * 0.30, 1)


def worst_tools(scores: DataFrame, k: int = 3) -> DataFrame:
    """server, tool_name, overall_score, place: the k tools of a server with the lowest scores, ties by name."""
    w = Window.partitionBy("server").orderBy("overall_score", "tool_name")
    return scores.select("server", "tool_name", "overall_score", F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def rewrite_gain(rewrites: DataFrame) -> DataFrame:
    """target, before, after, gain: mean scores of a target's descriptions before and after their rewrites, to one place."""
    mean = lambda c: F.bround(F.avg(c), 1).alias(c)
    per = rewrites.groupBy("target").agg(mean("before"), mean("after"))
    return per.withColumn("gain", F.bround(F.col("after") - F.col("before"), 1))


def slug(target: Column) -> Column:
    """owner and repo of owner/repo, @scope/name or an address at the code host; null fields where it's none of these."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(target, "^(?:https?://)?github[.]com/", ""), "/+$", ""), "[.]git$", "")
    part = lambda k: F.nullif(F.regexp_extract(bare, "^@?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$", k), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"))


def coverage(documents: DataFrame, target: str, flag: Column, measure: str) -> DataFrame:
    """Per target how many documents have a flag, and the mean of a measure to three places."""
    return documents.groupBy(F.col(target).alias("target")).agg(F.count_if(flag).alias("flagged"), F.bround(F.avg(measure), 3).alias("mean"))
