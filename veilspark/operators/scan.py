"""Source scans: pattern rules over whole files with line numbers, file contexts, hardening, and severity-weighted scores."""

from __future__ import annotations

import ast
import copy
import re
import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions import patterns as p
from veilspark.functions.spans import matches
from veilspark.functions.scoring import clamp

#: category, severity, pattern and the sources meant: all, py (not scripts) or js (scripts alone).
RULES = tuple((c, s, "(?i)" + x, "py" if c in p.PYTHON_ONLY else "all") for c, s, xs in p.COMMON for x in xs) + tuple((c, s, x, "js") for c, s, xs in p.SCRIPT for x in xs)
VALIDATES = r"(?i)validate|sanitize|check_|_check\b|_valid|raise\s+(?:ValueError|TypeError)|isinstance\s*\(|len\s*\(.*[<>]|not\s+\w+\s+or\s+len\s*\("
SECRETS = ("akia", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_", "pk_", "xox", "-----begin", "key=", "token=")
TELLING = ("token", "secret", "password", "key", "credential", "authorization", "bearer", "x-api-key")
#: What a text must hold in lower case, one of them, for any pattern of a category to be able to match: a cheap test before the patterns.
HINTS = {
    "path_traversal": ("os.path.join",), "command_injection": ("os.system(", "os.popen(", "subprocess."), "dangerous_eval": ("exec(", "eval("), "sql_injection": ('f"', "f'", ".execute("),
    "hardcoded_credential": ("api_key", "token", "secret", "password"), "unsafe_deserialization": ("pickle.", "yaml.", "marshal.", "shelve."), "ssrf": ("requests.", "httpx."), "no_input_validation": ("@",),
    "unsafe_path_resolution": ("path(", "open("), "async_shell_injection": ("create_subprocess_shell", "asyncio.subprocess"), "basic_auth_in_url": ("http",), "timing_attack_comparison": ("==",), "input_reflection": ("return",),
    "excessive_permissions": ("@",), "tool_description_poison": ("<important>", "<hidden>", "<secret>", "<system>", "description", "__doc__"), "token_leakage": TELLING, "metadata_secret_leak": SECRETS,
    "prototype_pollution": ("object.assign", "[", ".merge("), "child_process_injection": ("exec",), "ts_unsafe_eval": ("function(", "eval(", "vm.run"), "ts_sql_injection": (".query(", ".execute("), "ts_async_injection": ("spawn(", "deno.run("),
    "ts_path_traversal": ("path.join(", "fs.", "deno.read", "bun.file("), "ts_tool_description_poison": ("<important>", "<hidden>", "<secret>", "<system>", "description"), "ts_token_leakage": ("`", "authorization", "bearer", "x-api-key"),
    "ts_input_reflection": ("`",), "ts_metadata_secret_leak": SECRETS,
}
WEIGHTS = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.25, "info": 0.1}
# Hardening categories with the line that shows each.
HARDENING = {"credential": r"os\.environ|os\.getenv|process\.env", "path_traversal": r"open\(|Path\(", "sql_injection": r"execute\(.*f[\"']", "truncation": r"fetchall|SELECT", "read_only": r"INSERT|UPDATE|DELETE|DROP"}


def line_number(text: Column, start: Column) -> Column:
    before = F.left(text, start.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _validated(rest: pd.Series) -> pd.Series:
    """Whether the body of a function, whose text after the match is given, checks its input: indentation decides where it ends."""
    wanted, quotes = re.compile(VALIDATES), ('"""', "'''")

    def body(text: str) -> str:
        kept, indent, open_quote = [], None, False
        for line in text.split("\n"):
            bare = line.lstrip()
            if open_quote:
                open_quote = not any(q in bare for q in quotes)
            elif indent is None and (not bare or bare.startswith("#")):
                continue
            elif indent is None and bare.startswith(quotes):
                open_quote = bare.count(bare[:3]) < 2
            else:
                indent = len(line) - len(bare) if indent is None else indent
                if bare and len(line) - len(bare) < indent:
                    break
                kept.append(bare)
                if bare and len(kept) >= 30:
                    break
        return "\n".join(kept)

    return rest.map(lambda text: text is not None and wanted.search(body(text)) is not None)


def issues(files: DataFrame, text_col: str = "content", rules=RULES) -> DataFrame:
    """files' other columns, category, severity, line, confidence and matched text: a row per match of each pattern.

    Rules for scripts or Python alone look at column ext if there is one. A first pass tests which patterns hold at
    all; only those are matched with places. Matches beside a harmless form are left out, and confidence is low where
    the file has a safer form. Null texts have no issues.
    """
    text, rest = F.col(text_col), [c for c in files.columns if c != text_col]
    js = F.col("ext").isin("ts", "js") if "ext" in files.columns else F.lit(None).cast("boolean")
    meant = {"all": F.lit(True), "py": F.coalesce(~js, F.lit(True)), "js": F.coalesce(js, F.lit(False))}
    used = [r for r in rules if r[3] != "js" or "ext" in files.columns]
    none = F.array().cast("array<int>")
    may = lambda c: reduce(Column.__or__, [F.col("_low").contains(h) for h in HINTS[c]]) if c in HINTS else F.lit(True)
    numbered = [(i, c, x, scope) for i, (c, _, x, scope) in enumerate(used)]
    groups = {(c, scope): [(i, x) for i, k, x, sc in numbered if (k, sc) == (c, scope)] for _, c, _, scope in numbered}
    held = F.flatten(F.array(*[F.when(meant[scope] & may(c), F.array_compact(F.array(*[F.when(text.rlike(x), F.lit(i)) for i, x in xs]))).otherwise(none) for (c, scope), xs in groups.items()]))
    table = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(x).alias("pattern"), F.lit(scope).alias("scope")) for c, s, x, scope in used])
    hit = files.withColumn("_low", F.lower(text)).withColumn("_i", F.explode(held)).drop("_low").withColumn("_r", F.element_at(table, F.col("_i") + 1))
    hit = hit.withColumn("_m", F.explode(F.coalesce(*[F.when(F.col("_i") == i, matches(text, x)) for i, _, x, _ in numbered])))  # each pattern is compiled once
    start, end = F.col("_m.start").cast("int"), F.col("_m.end").cast("int")
    cut = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    last_line = lambda c: F.element_at(F.split(c, "\n"), -1)
    early = F.greatest(start - 200, F.lit(0))
    window = F.concat(last_line(F.left(text, early)), cut(early, end + 500 - early))
    around = F.when(F.col("_r.scope") == "js", window).otherwise(F.concat(last_line(F.left(text, start)), F.col("_m.value"), F.substring_index(cut(end, F.length(text) - end), "\n", 1)))
    any_of = lambda xs: "|".join(f"(?:{x})" for x in xs)
    category = F.col("_r.category")
    harmless = F.coalesce(*[F.when(category == c, around.rlike("(?i)" + any_of(xs))) for c, xs in p.HARMLESS.items()], F.lit(False))
    safer = F.coalesce(*[F.when(category == c, text.rlike(any_of(xs))) for c, xs in p.SAFER.items()], F.lit(False))
    out = hit.where(~harmless).withColumn("_rest", F.when(category == "no_input_validation", cut(end, F.length(text) - end)))
    if any(r[0] == "no_input_validation" for r in used):
        out = out.withColumn("_ok", F.pandas_udf(_validated, "boolean")("_rest")).where(~F.col("_ok"))
    return out.select(*rest, "_r.category", "_r.severity", line_number(text, start).alias("line"), F.when(safer, "low").otherwise("medium").alias("confidence"), F.col("_m.value").alias("matched"))


def file_context(path: Column) -> Column:
    """test, build, benchmark, ctf, migration, platform, cli or runtime: the first whose folder or file name fits."""
    parts, name = F.split(path, "[/\\\\]"), F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))
    fits = lambda dirs, x: (F.arrays_overlap(parts, F.array(*map(F.lit, dirs))) if dirs else F.lit(False)) | (name.rlike(x) if x else F.lit(False))
    found = [F.when(fits(dirs, x) | (F.lower(path).rlike("damn[-_]vulnerable") if c == "ctf" else F.lit(False)), F.lit(c)) for c, dirs, x in p.CONTEXTS]
    return F.coalesce(*found, F.lit("runtime"))


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "[/\\\\]"), F.array(*map(F.lit, p.EXCLUDED_FOLDERS))) | F.element_at(F.split(path, "[/\\\\]"), -1).rlike(p.EXCLUDED_NAMES)


def scoped(files: DataFrame, inside: str) -> DataFrame:
    """files (target, path): where a target has over 50 of them, those whose path fits `inside`, unless these are none or 80% or more."""
    per = files.groupBy("target").agg(F.count("*").alias("_n"), F.count_if(F.col("path").rlike(inside)).alias("_in"))
    narrow = (F.col("_n") > 50) & (F.col("_in") > 0) & (F.col("_in") < 0.8 * F.col("_n"))
    return files.join(per, "target").where(~narrow | F.col("path").rlike(inside)).drop("_n", "_in")


def severity_counts(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def security_scores(files: DataFrame, found: DataFrame) -> DataFrame:
    """Per target 10 less its issues' weights, to one place; 5 for a target without a source (null path)."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in WEIGHTS.items()], F.lit(0.25))
    loss = found.groupBy("target").agg(F.sum(weight).alias("loss"))
    sources = files.groupBy("target").agg(F.count("path").alias("sources"))
    score = F.when(F.col("sources") == 0, 5.0).otherwise(F.bround(clamp(10.0 - F.coalesce("loss", F.lit(0.0))), 1))
    return sources.join(loss, "target", "left").select("target", score.alias("security_score"))


def hardening(files: DataFrame, read_only: bool = False, limit: int = 100) -> DataFrame:
    """path, category and code: whole-file predicates that ask for hardening, with the lines around the first that shows it."""
    text = F.col("content")
    upper = F.upper(text)
    has = lambda *xs: [text.contains(x) for x in xs]
    env, fetch = has("os.environ", "os.getenv", "process.env"), text.contains("fetchall") | upper.contains("SELECT")
    asked = {
        "credential": env[0] | env[1] | env[2],
        "path_traversal": text.rlike(HARDENING["path_traversal"]) & ~text.contains("..") & ~text.contains("resolve") & ~text.contains("is_relative_to"),
        "sql_injection": text.rlike(HARDENING["sql_injection"]),
        "truncation": fetch & ~upper.contains("LIMIT") & ~text.contains(str(limit)),
        "read_only": F.lit(read_only) & text.rlike("(?i)INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE") & ~text.contains("read_only") & ~text.contains("readonly"),
    }
    lines = F.split(text, "\r?\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    found = files.where(~F.col("path").rlike("node_modules|__pycache__")).withColumn("category", F.explode(F.array_compact(F.array(*[F.when(q, F.lit(c)) for c, q in asked.items()]))))
    shows = lambda x: F.coalesce(*[F.when(F.col("category") == c, x.rlike("(?i)" + y)) for c, y in HARDENING.items()])
    code = F.array_join(F.transform(F.filter(numbered, lambda x: x["n"].between(F.col("_at") - 3, F.col("_at") + 6)), lambda x: F.concat(x["n"].cast("string"), F.lit(": "), x["line"])), "\n")
    return found.withColumn("_at", F.try_element_at(F.transform(F.filter(numbered, lambda x: shows(x["line"])), lambda x: x["n"]), F.lit(1))).select("path", "category", F.coalesce(code, F.lit("")).alias("code"))


def reported_issues(reports: DataFrame) -> DataFrame:
    """path, line, category, severity, message from analysers' JSON reports (column report), each place and category once; unreadable ones give none."""
    kind = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<category:string,severity_level:string>>>>>"
    r = reports.select(F.explode(F.from_json("report", kind)["results"]).alias("r")).select("r.*")
    category = F.coalesce(F.nullif("extra.metadata.category", F.lit("")), F.replace(F.regexp_replace(F.substring_index("check_id", ".", -1), "^mcp-", ""), F.lit("-"), F.lit("_")))
    level = F.lower(F.coalesce(F.nullif("extra.metadata.severity_level", F.lit("")), F.when(F.col("extra.severity") == "ERROR", "high").when(F.col("extra.severity") == "INFO", "low").otherwise("medium")))
    shaped = r.select("path", F.col("start.line").alias("line"), category.alias("category"), F.when(level.isin(*WEIGHTS), level).otherwise("medium").alias("severity"), F.col("extra.message").alias("message")).where("category <> ''")
    return shaped.groupBy("path", "line", "category").agg(F.min_by(F.struct("severity", "message"), F.struct("severity", "message")).alias("x")).select("path", "line", "category", "x.*")


class _NoArguments(ast.NodeTransformer):
    """Calls without what they are given, so that their text is the chain of names alone."""

    def visit_Call(self, node: ast.Call) -> ast.Call:
        return ast.Call(func=self.visit(node.func), args=[], keywords=[])


def _name(func: ast.expr) -> str:
    """Dotted name of what is called, at its end; of a call within, like the first in Path(x).unlink(), only the last name counts."""
    chain = re.sub(r"(?:\w+\.)*(\w+)\(\)", r"\1", ast.unparse(_NoArguments().visit(copy.deepcopy(func))))
    return chain[len(chain.rstrip(string.ascii_letters + string.digits + "_.")) :].strip(".")


def _labels(name: str, rows: tuple[tuple[str, str], ...]) -> list[str]:
    """The label of the first row that is the whole name or its end after a dot."""
    ends = {name, *(name[k + 1 :] for k, c in enumerate(name) if c == ".")}
    return [label for call, label in rows if call in ends][:1]


def _roles(tree: ast.AST) -> tuple[list[str], ...]:
    """Labels of sources, sinks and destructive calls anywhere below a node, each once, by their places."""
    met: tuple[list, ...] = ([], [], [])
    for node in ast.walk(tree):
        place = (getattr(node, "lineno", 0), getattr(node, "col_offset", 0), -getattr(node, "end_lineno", 0), -getattr(node, "end_col_offset", 0))
        if isinstance(node, ast.Call) and (name := _name(node.func)):
            for into, rows in zip(met, (p.CALL_SOURCES, p.CALL_SINKS, p.CALL_DESTRUCTIVE), strict=True):
                into += [(place, label) for label in _labels(name, rows)]
        elif isinstance(node, ast.Subscript | ast.Attribute):
            met[0].extend((place, label) for text, label in (("os.environ", "os.environ"), ("os.environ[]", "os.environ[]")) if text == _plain(node))
    return tuple(list(dict.fromkeys(label for _, label in sorted(x))) for x in met)


def _plain(node: ast.expr) -> str:
    """The text of a name with dots, with [] for any subscript of one."""
    return ast.unparse(node.value) + "[]" if isinstance(node, ast.Subscript) else ast.unparse(node)


def function_flows(files: DataFrame) -> DataFrame:
    """path, function, flow, sources, targets: Python functions (and the module's own statements) that read data and send or destroy it.

    Sources that can't be parsed, null ones among them, have none. Syntax trees need Python; batches pass by Arrow.
    """
    schema = "path string, function string, flow string, sources array<string>, targets array<string>"

    def of(text: str | None):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        parts = [(n.name, n) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        loose = [n for n in tree.body if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        for name, node in [*parts, *([("<module>", ast.Module(body=loose, type_ignores=[]))] if loose else [])]:
            sources, sinks, destructive = _roles(node)
            if sources and sinks:
                yield name, "exfiltration", sources, sinks
            other = [s for s in sources if "subprocess" not in s]
            if other and destructive:
                yield name, "destructive", sources, destructive

    def batches(frames):
        for frame in frames:
            rows = [(path, *flow) for path, text in zip(frame["path"], frame["content"]) for flow in of(text)]
            yield pd.DataFrame(rows, columns=["path", "function", "flow", "sources", "targets"])

    return files.select("path", "content").mapInPandas(batches, schema)


def without_suppressed(reported: DataFrame, files: DataFrame) -> DataFrame:
    """reported issues (path, line, category) less those beside a harmless form: in the six lines before, the own one or the
    23 after it. Issues of files that aren't there stay."""
    lines = files.select("path", F.split("content", "\n").alias("_lines"))
    first = F.greatest(F.col("line") - 6, F.lit(1))
    around = F.array_join(F.slice("_lines", first, F.col("line") + 24 - first), "\n")
    any_of = lambda xs: "(?i)" + "|".join(f"(?:{x})" for x in xs)
    harmless = F.coalesce(*[F.when(F.col("category") == c, around.rlike(any_of(xs))) for c, xs in p.HARMLESS.items()], F.lit(False))
    return reported.join(lines, "path", "left").where(~F.coalesce(harmless, F.lit(False))).drop("_lines")


def in_scope(reported: DataFrame, kept: DataFrame) -> DataFrame:
    """reported issues whose file is among those that a scan keeps (path)."""
    return reported.join(kept.select("path").distinct(), "path", "left_semi")


def worst_issues(found: DataFrame, key: str, k: int = 15) -> DataFrame:
    """The k most severe issues of each target, by severity, then file, line and category."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(WEIGHTS)], F.lit(len(WEIGHTS)))
    w = Window.partitionBy(key).orderBy(rank, "path", "line", "category")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
