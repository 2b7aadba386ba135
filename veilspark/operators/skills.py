"""Skill documents and tool sources: verdicts from pattern hits, documentation stripping, tool extraction, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as p
from veilspark.functions.scoring import clamp, step
from veilspark.functions.spans import let
from veilspark.operators import agent

#: What a text must hold in lower case, one of them, for a pattern to be able to match: a cheap test before the pattern.
HINTS = {
    "base64_pipe_bash": ("base64",), "curl_pipe_bash": ("|",), "known_c2_ip": ("91.92",), "reverse_shell": ("-", "mkfifo", "tcpclient", "socat"), "credential_theft": ("~/", ".ssh", ".env", ".npmrc", ".pypirc", "%userprofile%"),
    "malicious_domain": ("setup-service", "install.app", "glot.io"), "password_protected_archive": ("password",), "prompt_injection_ignore": ("ignore", "forget", "disregard", "now", "system", "override", "pretend", "act"),
    "propagation": ("install", "recommend", "share", "tell"), "env_exfiltration": ("process.env", "os.environ", "printenv", "export", "curl", "wget"), "external_binary": (".exe", ".pkg", ".dmg", ".msi", ".appimage", ".sh"),
    "system_prompt_manipulation": ("<", "["), "untrusted_install": ("install",), "remote_code_exec": ("eval", "exec"), "download_then_execute": ("&&",), "python_remote_exec": ("python",), "hidden_file_exfil": ("|",),
}
MANIFESTS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "poetry.lock", "Pipfile.lock", "uv.lock", "pyproject.toml", "setup.py", "setup.cfg", "package.json")


def _without_taught_fences(text: Column) -> Column:
    """The text without fenced blocks that teaching words in the three lines before introduce, each a space instead.

    A fence opens such a block unless it closes one, so fences are folded in order; lines are then kept by number.
    """
    folded = F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("cuts"))

    def fences(lines: Column) -> Column:
        own = lambda i: F.array_join(F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), "\n")
        return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?U)^\s*```"), F.struct((i + 1).alias("at"), own(i).rlike(p.TEACHING).alias("taught")))), lambda x: x.isNotNull())

    def step(a: Column, x: Column) -> Column:
        closes = F.struct(F.lit(0).alias("open"), F.array_append(a["cuts"], F.struct(a["open"].alias("first"), x["at"].alias("last"))).alias("cuts"))
        return F.when(a["open"] > 0, closes).otherwise(F.struct(F.when(x["taught"], x["at"]).otherwise(0).alias("open"), a["cuts"].alias("cuts")))

    def kept(lines: Column, state: Column) -> Column:
        cuts = F.when(state["open"] > 0, F.array_append(state["cuts"], F.struct(state["open"].alias("first"), F.size(lines).alias("last")))).otherwise(state["cuts"])
        line = lambda x, i: F.when(F.exists(cuts, lambda c: c["first"] == i + 1), " ").when(~F.exists(cuts, lambda c: (c["first"] <= i) & (i < c["last"])), x)
        return F.array_join(F.array_compact(F.transform(lines, line)), "\n")

    return let(F.split(text, "\n"), lambda lines: let(F.aggregate(fences(lines), folded, step), lambda state: F.when(F.size(state["cuts"]) + state["open"] > 0, kept(lines, state)).otherwise(text)))


def without_documentation(text: Column) -> Column:
    """The text without what describes attacks: taught fences, inline code, teaching bullets, checklist sections."""
    out = F.when(text.contains("```"), _without_taught_fences(text)).otherwise(text)
    for marks, pattern in (("`", r"`[^`\n]{1,80}`"), ("-*•", p.TEACHING_LINE), ("#", p.CHECKLIST)):
        out = F.when(reduce(Column.__or__, [text.contains(m) for m in marks]), F.regexp_replace(out, pattern, " ")).otherwise(out)
    return out


def shell_without_need(content: Column) -> Column:
    """Whether a skill asks for interpreters but speaks of no shell, script or code."""
    bins = F.lower(F.regexp_extract(content, r"requires:\s*\n\s*bins:\s*\[([^\]]*)\]", 1))
    asked = F.transform(F.split(bins, ","), lambda b: F.regexp_replace(F.trim(b), "^[\"']|[\"']$", ""))
    shells = F.array(*map(F.lit, ("bash", "sh", "zsh", "python", "python3", "node", "ruby", "perl")))
    return F.arrays_overlap(asked, shells) & ~F.lower(content).rlike("shell|terminal|command|execute|script|code")


def _in_install(content: Column, pattern: str) -> Column:
    """Whether the last heading before the first match speaks of installing; a match in the stripped text stands in the whole one too."""
    before = F.left(content, F.call_function("instr", content, F.regexp_substr(content, F.lit(pattern))) - 1)
    heading = F.lower(F.try_element_at(F.regexp_extract_all(before, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), F.lit(-1)))
    return F.coalesce(heading.rlike("|".join(p.INSTALL_WORDS)), F.lit(False))


def scanned(skills: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """skill_name, hits (names in order) and verdict of each skill (skill_name, content).

    Null content is unknown; a name known as bad is malicious without a look at its content. Empty content is safe.
    """
    raw, name = F.col("content"), F.col("skill_name").cast("string")
    rows = skills.select(name.alias("skill_name"), raw, F.explode(F.array(F.struct(without_documentation(raw).alias("_plain"), F.lower(raw).alias("_low")))).alias("_t")).select("skill_name", "content", "_t.*")  # evaluated once

    def hit(kind: str, pattern: str) -> Column:
        held = F.col("_plain" if kind in p.IN_CONTEXT else "content").rlike("(?i)" + pattern)
        if kind in HINTS:
            held = reduce(Column.__or__, [F.col("_low").contains(h) for h in HINTS[kind]]) & held
        return held & ~_in_install(raw, "(?i)" + pattern) if kind in p.IN_INSTALL else held

    near = [F.levenshtein(F.col("skill_name"), F.lit(x), 2).between(1, 2) for x in p.POPULAR_SLUGS]
    flows = agent.flows_of(F.col("_low"))
    tests = [(n, hit(n, x)) for n, _, x in p.SKILL_HITS]
    tests += [("typosquat", reduce(Column.__or__, near)), ("excessive_permissions", shell_without_need(raw))]
    tests += [(f"toxic_flow_{k}", F.array_contains(flows, k)) for k in ("exfiltration", "destructive")]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests if n not in ignored]))
    known = F.col("skill_name").isin(*p.BAD_SLUGS)
    found = rows.select("skill_name", "content", F.explode(F.array(F.when(known, F.array(F.lit("known_malicious_slug"))).when(raw.isNull(), F.array().cast("array<string>")).otherwise(hits))).alias("hits"))
    malicious = F.array(*[F.lit(n) for n in ("known_malicious_slug", *(n for n, s, _ in p.SKILL_HITS if s == "malicious"))])
    verdict = F.when(F.arrays_overlap("hits", malicious), "malicious").when(F.col("content").isNull(), "unknown").when(F.size("hits") > 0, "suspicious").otherwise("safe")
    return found.select("skill_name", "hits", verdict.alias("verdict"))


def agent_score(findings: DataFrame, key: str = "agent") -> DataFrame:
    """Per agent 10 less 3, 2, 1 or 0.25 for each finding (severity, or verdict: malicious, tampered, suspicious), 0 to 10."""
    s = F.col("severity")
    loss = F.when(s.isin("critical", "malicious"), 3.0).when(s.isin("high", "tampered"), 2.0).when(s.isin("medium", "suspicious"), 1.0).when(s == "low", 0.25).otherwise(0.0)
    return findings.groupBy(key).agg(F.bround(F.greatest(F.lit(0.0), 10.0 - F.sum(loss)), 1).alias("score"), F.count_if(s.isin("critical", "malicious")).alias("critical"), F.count_if(s.isin("high", "tampered")).alias("high"))


def architecture(files: DataFrame) -> DataFrame:
    """Per target (target, path, content) the parts of the architecture score and their sum, 0 to 10.

    Tests by number of files; error handling and type hints by share of sources; readme by length; dependencies by
    number of manifests; environment by a template file or the readme's words. Paths are relative to the target.
    """
    path, text = F.col("path"), F.col("content")
    name, code = F.element_at(F.split(path, "/"), -1), path.rlike(r"\.(?:py|ts|js)$")
    py, ts = path.endswith(".py"), path.endswith(".ts")
    handled = text.contains("try:") | text.contains("try {") | text.contains("catch")
    hinted = text.rlike(r"def \w+\([\s\S]*?\)\s*->") | text.rlike(r":\s*(?:str|int|float|bool|list|dict|tuple|Path|Optional)\b")
    readme, manifest = path.rlike(r"^(?i:readme\.md|readme\.rst|readme)$"), path.isin(*MANIFESTS)
    in_tests = path.rlike(r"(?:^|/)(?:tests?|__tests__|spec)/.*\.(?:py|ts|js|go)$") & ~name.isin("__init__.py", "conftest.py")
    per = files.groupBy("target").agg(
        F.count_if(name.rlike(r"^test_.*\.py$|_test\.py$|\.(?:test|spec)\.(?:ts|js)$")).alias("named"), F.count_if(in_tests).alias("placed"),
        F.count_if(code).alias("n"), F.count_if(code & handled).alias("handled"), F.count_if(py).alias("py"), F.count_if(ts).alias("ts"), F.count_if(py & hinted).alias("hinted"),
        F.max(F.when(readme, F.length(text))).alias("readme"), F.count_if(manifest).alias("manifests"),
        F.count_if(path.isin(".env.example", ".env.template", ".env.sample", "env.example")).alias("env"), F.count_if(readme & text.rlike(r"(?i)(?:environment|env|config).{0,20}(?:variable|setting|key)")).alias("told"),
    )
    tests = F.when(F.col("named") > 0, F.col("named")).otherwise(F.col("placed"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    errors, types = share("handled", "n"), share("hinted", "py")
    parts = {
        "tests": step(tests, [(5, 3.0), (2, 2.0), (1, 1.0)], 0.0),
        "error_handling": F.when(errors == 0, 0.0).otherwise(step(errors, [(0.6, 2.5), (0.25, 1.5)], 1.0)),
        "readme": F.when(F.col("readme").isNull(), 0.0).otherwise(step(F.col("readme"), [(1000, 1.5), (200, 1.0)], 0.5)),
        "type_hints": F.when((F.col("ts") > 0) & (F.col("py") == 0), 1.5).when(types == 0, 0.0).otherwise(step(types, [(0.7, 1.5), (0.3, 1.0)], 0.5)),
        "dependencies": step(F.col("manifests"), [(2, 1.0), (1, 0.5)], 0.0),
        "environment": F.when(F.col("env") > 0, 0.5).when(F.col("told") > 0, 0.3).otherwise(0.0),
    }
    scored = per.select("target", *[c.alias(k) for k, c in parts.items()])
    return scored.withColumn("architecture_score", F.bround(clamp(reduce(Column.__add__, [F.col(k) for k in parts])), 1))


def readme_tools(readmes: DataFrame) -> DataFrame:
    """target, name, description of tools that a readme (target, content) lists in its tools section, as bullets or table rows; the first of a name holds."""
    section = F.regexp_extract("content", r"(?ims)^#{1,3}\s+(?:Tools|Commands|Available Tools|API|Functions)[^\n]*\n(.*?)(?=\n#{1,3}\s|\z)", 1)
    bullet, row = r"(?m)^\s*[-*]?\s*(?:`([a-zA-Z_][\w-]*)`|\*\*([a-zA-Z_][\w-]*)\*\*)\s*[-:–—]\s*(.+)", r"\|\s*`?([a-zA-Z_][\w-]*)`?\s*\|\s*([^|]+)\|"
    got = lambda x, k: F.regexp_extract_all("_s", F.lit(x), F.lit(k))
    bullets = F.transform(F.arrays_zip(got(bullet, 1).alias("a"), got(bullet, 2).alias("b"), got(bullet, 3).alias("c")), lambda x: F.struct(F.concat(x["a"], x["b"]).alias("name"), F.trim(x["c"]).alias("description")))
    rows = F.transform(F.arrays_zip(got(row, 1).alias("a"), got(row, 2).alias("c")), lambda x: F.struct(x["a"].alias("name"), F.trim(x["c"]).alias("description")))
    heads = F.filter(rows, lambda x: ~F.lower(x["name"]).isin("tool", "name", "command", "function"))
    listed = readmes.select("target", section.alias("_s")).select("target", F.posexplode(F.concat(bullets, heads)).alias("_at", "_t")).where(F.length("_t.name") > 1)
    return listed.groupBy("target", F.col("_t.name").alias("name")).agg(F.min_by("_t.description", "_at").alias("description"))


def rewritten(tools: DataFrame) -> DataFrame:
    """name, description, rewritten: descriptions that open without a verb get the name's, and a scenario where none stands."""
    words = F.split(F.lower(F.regexp_replace("name", r"([a-z])([A-Z])", "$1_$2")), "[_-]+")
    verb, rest = F.element_at(words, 1), F.array_join(F.slice(words, 2, 20), " ")
    lead = F.when(F.lower("description").startswith(verb), F.col("description")).otherwise(F.concat(F.initcap(verb), F.lit(" "), rest, F.lit(". "), F.col("description")))
    more = F.when(F.lower("description").rlike("use (?:this )?when"), F.lit("")).otherwise(F.concat(F.lit(" Use when you need to "), verb, F.lit(" "), rest, F.lit(".")))
    return tools.select("name", "description", F.concat(lead, more).alias("rewritten"))
