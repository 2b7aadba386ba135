"""Tools declared in sources of ten languages, with their descriptions, and from readmes where no source declares any.

Forms of declarations are data: short templates, compiled to patterns. Arguments of decorators are read to three brackets
deep, with up to 99 bracketed ones at each depth (a matcher's stack is bounded). In a template

    'NAME' "NAME" NAME    the tool's name in either quotes, in double quotes, or bare
    'TEXT' "TEXT" `TEXT` TEXT    its description in either quotes, double quotes, backticks, or any of the three
    \"\"\"TEXT\"\"\"  'TEXT'+  "TEXT"..    a long string; strings joined by +; strings on following lines
    KEY WORD              names that are looked up in the same file, as name and as description
    a space               white space or none;  a middle dot: white space
    ~  ~300               anything, or up to so many characters;  {~}  {~300}  (~): the same without } or )
    <a|b>  <a|b>?         one of these; one or none

and all else stands for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import let

TOKENS = {
    "'NAME'": (r"[\"']([a-zA-Z_][\w-]*)[\"']", "n"), '"NAME"': (r'"([a-zA-Z_][\w-]*)"', "n"), "`NAME`": (r"`([a-zA-Z_][\w-]*)`", "n"), "'WORD'": (r"[\"'](\w+)[\"']", "n"), "'ANY'": (r"(?:'([^']*)'|\"([^\"]*)\")", "nn"),
    '"""TEXT"""': (r'"""([\s\S]*?)"""', "d"), "'''TEXT'''": (r"'''([\s\S]*?)'''", "d"), "'TEXT'+": (r"([\"'][^\"']*[\"'](?:\s*\+\s*[\"'][^\"']*[\"'])*)", "d"), '"TEXT"..': (r'"([^"]*(?:"\s*\n\s*"[^"]*)*)"', "d"),
    "'TEXT'": (r"[\"']([^\"']+)[\"']", "d"), '"TEXT"': (r'"([^"]+)"', "d"), "`TEXT`": (r"`([^`]+)`", "d"), "''TEXT''": (r"'([^']*)'", "d"), '""TEXT""': (r'"([^"]*)"', "d"),
    "KEY": (r"(\w+)", "k"), "WORD": (r"(\w+)", "w"), "NAME": (r"(\w+)", "n"), "TEXT": (r"(?:'([^']*)'|\"([^\"]*)\"|`([^`]*)`)", "ddd"),
    "->": ("->", ""),     " ": (r"\s*", ""), "·": (r"\s+", ""), "(~)": (r"[^)]*?", ""), "{~}": (r"[^}]*?", ""), "~": (r"[\s\S]*?", ""), "#ARGS#": (r"[^()]*?(?:\((?:[^()]*+(?:\((?:[^()]*+(?:\([^()]*+\)[^()]*+){0,99}+)\)[^()]*+){0,99}+)\)[^()]*?){0,99}?", ""), "#QUOTED#": (r'"[^"]*"', ""), "#QUOTELESS#": (r"[^\"']*?", ""), "#TYPE#": (r"[\w<>\[\]]+", ""), "#UPTO:#": (r"[^:]+", ""), "#ATTRIBUTES#": (r"(?:\[[\w\(\)\"=,\s]*\]\s*)*", ""), "#DECORATORS#": (r"(?:@[\w.]+(?:\([^)]*\))?\s*)*", ""), "#SERVER#": (r"\w*(?:mcp|server|app|fastmcp)\w*", ""),
}
_SPLIT = re.compile("|".join([r"~\d+", r"\{~\d+\}", r">\?", "[<>|]", *map(re.escape, sorted(TOKENS, key=len, reverse=True))]))


@dataclass(frozen=True)
class Form:
    """A form of declaration. joined: line ends in descriptions become spaces. required: without a description it's none."""

    template: str
    joined: bool = False
    required: bool = False
    name: str = ""
    without: tuple[str, ...] = ()

    def compiled(self) -> tuple[str, str]:
        """The pattern, and what each of its groups holds: name, description, key, word."""
        out, roles, at = "", "", 0
        for m in _SPLIT.finditer(self.template):
            out += re.escape(self.template[at : m.start()])
            token, at = m[0], m.end()
            if token in TOKENS:
                pattern, role = TOKENS[token]
            elif token[0] in "~{" and (limit := re.search(r"\d+", token)):
                pattern, role = f"{'[^}]' if token[0] == '{' else '[' + chr(92) + 's' + chr(92) + 'S]'}{{0,{limit[0]}}}?", ""
            else:
                pattern, role = {"<": "(?:", ">": ")", ">?": ")?", "|": "|"}[token], ""
            out, roles = out + pattern, roles + role
        return out + re.escape(self.template[at:]), roles


#: Names that object keys with a description have for other reasons, and what a loose name must look like (fixed values).
PLAIN_KEYS = ("type", "default", "title", "label", "name", "id", "key", "value", "message", "description", "scope", "inputSchema", "outputSchema", "annotations")
LOOSE = r"^[a-zA-Z_][\w.-]*$"
PYTHON = (
    Form('@#SERVER#.tool<(>?<)>? <async·>?def·NAME#QUOTELESS#"""TEXT"""'),
    Form("@#SERVER#.tool(#ARGS#description = <\"\"\"TEXT\"\"\"|'''TEXT'''|\"\"TEXT\"\"|''TEXT''>#ARGS#) #DECORATORS#<async·>?def·NAME ("),
    Form("@#SERVER#.tool(#ARGS#) #DECORATORS#<async·>?def·NAME (#ARGS#) <-> #UPTO:#>?: <\"\"\"TEXT\"\"\"|'''TEXT'''>"),
    Form("@#SERVER#.tool(#ARGS#) #DECORATORS#<async·>?def·NAME ("),
    Form('@tool <((~))>? <async·>?def·NAME ((~))~"""TEXT"""'),
    Form("Tool( name = 'WORD' , description = <\"\"\"TEXT\"\"\"|'TEXT'>"),
    Form("Tool( 'NAME' , <description = >?<\"\"\"TEXT\"\"\"|\"TEXT\"..>", required=True),
    Form("Tool( name = NAME.KEY , description = 'TEXT'"),
)
SCRIPT = (
    Form("server.tool( 'WORD'~description: TEXT"),
    Form("server.registerTool( 'NAME' , {{~}description: <`TEXT`|'TEXT'+>", joined=True),
    Form("name: 'ANY' <as·const>? ,{~400}description: TEXT", joined=True, name=LOOSE),
    Form("name:·KEY ,~description:·WORD ,", required=True),
    Form("NAME : { description : TEXT", joined=True, without=PLAIN_KEYS),
    Form(".tool( 'NAME' , <'TEXT'|`TEXT`>", joined=True),
    Form("name: 'NAME'{~300}description: 'TEXT'{~300}<parameters|schema|inputSchema> :"),
    Form("const name = 'NAME'~registerTool( name ,"),
    Form("registerTool( name ,~const name = 'NAME'"),
)
FORMS = {
    "py": PYTHON,
    "ts": SCRIPT,
    "js": SCRIPT,
    "go": (
        Form("mcp.NewTool( 'NAME'~500<mcp.>?WithDescription( 'TEXT'"),
        Form('mcp.Tool {{~}Name: <"NAME"|`NAME`>{~}Description: <t( #QUOTED# , <"TEXT"|`TEXT`> )|"TEXT"|`TEXT`>', joined=True, required=True),
        Form("<mcp.>?Tool {{~}Name: 'NAME'{~}Description: 'TEXT'"),
        Form(".<AddTool|RegisterTool>( 'NAME' , 'TEXT'"),
        Form('.MustTool( "NAME" , "TEXT"'),
        Form("ToolDefinition {{~}Name: 'NAME'{~}Description: 'TEXT'"),
    ),
    "rs": (
        Form('#[<tool|mcp_tool> ((~)description = "TEXT"(~))] <pub·>?<async·>?fn·NAME'),
        Form('Tool::new( "NAME" , "TEXT"'),
        Form('ToolBuilder::new( "NAME" )~.description( "TEXT"'),
    ),
    "java": (
        Form('@<Tool|McpTool> ((~)description = "TEXT"(~)) <public·|private·|protected·>?<suspend·>?<fun·|#TYPE#·>NAME ('),
        Form('Tool.builder()~200.name( "NAME" )~200.description( "TEXT"'),
        Form('new·Tool( "NAME" , "TEXT"'),
        Form('.<addTool|registerTool>( "NAME" , "TEXT"'),
        Form('ToolSpecification( "NAME" , "TEXT"'),
    ),
    "php": (
        Form("#[Tool ((~)name: 'NAME'(~)description: 'TEXT'"),
        Form("-><registerTool|addTool>( 'NAME' , 'TEXT'"),
        Form("<new·Tool|Tool::<create|make>>( 'NAME' , 'TEXT'"),
        Form("ToolDefinition::fromName( 'NAME'~200->description( 'TEXT'"),
    ),
    "rb": (
        Form("tool·'NAME' , description: 'TEXT'"),
        Form("register_tool( 'NAME' , 'TEXT'"),
        Form("name: 'NAME' , description: 'TEXT'"),
    ),
    "cs": (
        Form('[<McpTool|Tool> ((~)Name = "NAME"(~)Description = "TEXT"'),
        Form('[Description("TEXT")] #ATTRIBUTES#public·KEY·NAME ('),
    ),
}
#: Extensions that share a language's forms, and in which order languages are read.
SAME = {"kt": "java", "kts": "java"}
ORDER = ("py", "ts", "js", "go", "rs", "java", "kt", "kts", "php", "rb", "cs")
FOUND = "array<struct<form:int,place:int,name:string,description:string>>"
#: Folders and files that hold no tools of the server (fixed values).
SKIPPED = ("node_modules", "__pycache__", ".venv", "venv", "env", ".env", ".git", "dist", "build", ".tox", ".mypy_cache", "site-packages", ".nox", "tests", "test", "__tests__", "spec", "fixtures", "fixture", "benchmarks", "benchmark", "testdata", "test_data", "e2e", "integration_tests")
TEST_FILE = r"(?:^|/)(?:test_[^/]*|[^/]*_test\.(?:py|go)|[^/]*\.(?:test|spec)\.(?:ts|js)|[^/]*\.d\.ts)$"


def sources(files: DataFrame) -> DataFrame:
    """files whose path (relative to their target) is in no skipped folder and isn't a test's."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & ~F.col("path").rlike(TEST_FILE))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _assigned(content: Column, ext: str) -> Column:
    """Names that a file sets to texts, as pairs."""
    script = ext in ("ts", "js")
    pattern = r"const\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|`([^`]*)`)" if script else r"(\w+)\s*=\s*[\"'](\w+)[\"']"
    whole = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    parts = [lambda m, g=g: F.regexp_extract(m, pattern, g) for g in range(2, 5 if script else 3)]
    value = lambda m: F.concat(*[p(m) for p in parts])
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("k"), _stripped(value(m)).alias("v")))


def _declared(content: Column, ext: str, number: int, form: Form) -> Column:
    pattern, roles = form.compiled()
    groups = lambda m, role: [F.regexp_extract(m, pattern, i + 1) for i, r in enumerate(roles) if r == role]
    held = lambda xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit("")) if xs else F.lit("")
    look = lambda pairs, x, other: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == x), F.lit(-1))["v"], other)

    def found(pairs: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            name, text = held(groups(m, "n")), held(groups(m, "d"))
            if "k" in roles and ext == "py":  # a member of an enumeration: its value, else its own name
                name = look(pairs, groups(m, "k")[0], F.lower(groups(m, "k")[0]))
            elif "w" in roles:
                name, text = (look(pairs, groups(m, r)[0], F.lit("")) for r in "kw")
            elif not any(r in roles for r in "dw") and ext in ("ts", "js"):  # said apart: the first description of the file
                text = F.regexp_extract(content, r"description:\s*[\"']([^\"']+)[\"']", 1)
            if "'TEXT'+" in form.template:
                text = F.regexp_replace(F.regexp_replace(text, r"[\"']\s*\+\s*[\"']", ""), r"^[\"']|[\"']$", "")
            text = _stripped(F.regexp_replace(text, r'"\s*\n\s*"' if '"TEXT"..' in form.template else r"\s*\n\s*", " ") if form.joined or '"TEXT"..' in form.template else text)
            return F.struct(F.lit(number).alias("form"), i.alias("place"), _stripped(name).alias("name"), text.alias("description"))

        all_ = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), one)
        tests = [lambda x: x["name"] != ""]
        tests += [lambda x: x["description"] != ""] if form.required else []
        tests += [lambda x: x["name"].rlike(form.name)] if form.name else []
        tests += [lambda x: ~x["name"].isin(*form.without)] if form.without else []
        return F.filter(all_, lambda x: reduce(Column.__and__, [t(x) for t in tests]))

    looked = "k" in roles and ext != "cs"
    out = let(_assigned(content, ext), found) if looked else found(F.lit(None))
    return F.when(content.rlike(pattern), out).otherwise(F.array().cast(FOUND))


def declared(files: DataFrame) -> DataFrame:
    """files' other columns, language, form, place, name and description of each declaration in sources (ext, content)."""
    content, rest = F.col("content"), [c for c in files.columns if c != "content"]
    none = F.array().cast(FOUND)
    each = [F.when(F.col("ext") == ext, F.concat(*[_declared(content, ext, i, f) for i, f in enumerate(FORMS[SAME.get(ext, ext)])])) for ext in ORDER]
    rows = files.select(*rest, F.explode(F.coalesce(*each, none)).alias("_t"))
    return rows.select(*rest, (F.array_position(F.array(*map(F.lit, ORDER)), F.col("ext")) - 1).cast("int").alias("language"), "_t.*")


def extracted_tools(files: DataFrame) -> DataFrame:
    """path, tool_name, description: tools declared in sources (path, ext, content), the first of a name in a file."""
    first = declared(files.select("path", "ext", "content")).groupBy("path", F.col("name").alias("tool_name"))
    return first.agg(F.min_by("description", F.struct("form", "place")).alias("description"))


def server_tools(files: DataFrame, readmes: DataFrame) -> DataFrame:
    """target, name, description: tools of a server's sources (target, path, ext, content), the first of a name by
    language, file and form; of targets without any, the tools that their readme (target, content) lists."""
    from veilspark.operators.skills import readme_tools

    first = declared(sources(files).select("target", "path", "ext", "content")).groupBy("target", "name")
    coded = first.agg(F.min_by("description", F.struct("language", "path", "form", "place")).alias("description"))
    listed = readme_tools(readmes.join(coded.select("target").distinct(), "target", "left_anti"))
    return coded.unionByName(listed.select("target", "name", "description"))
