"""Symbols, routes and imports from the statements of source files, by tables of patterns and windows over one sort per file.

No parser: a definition is a statement whose code matches a pattern of its grammar; its span ends where the block it opens does.
Strings and comments are masked before, so a definition, brace or import in them counts for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetables.operators import resolve
from codetables.operators.scan import statements
from codetables.sources import tables

_ID = r"[A-Za-z_$][\w$]*"
_NO_CALL = r"(?!(?:if|for|while|switch|catch|return|function|new|else|throw|case|assert|do|synchronized)\b)"
_JS = [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"), ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*{_NO_CALL}[*#]?({_ID})\s*(?:<[^>]*>)?\([^;]*?\)\s*(?::[^{{]+)?\{{")]
_JVM_TYPE = rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|sealed|open|data|case|inner|enum|override|internal)\s+)*(?:class|interface|enum|record|object|trait)\s+({_ID})"
_JAVA_HEAD = rf"^\s+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|default|native|synchronized)\s+)*(?:<[^()]*>\s*)?"
_JAVA_TYPE = r"(?!(?:return|new|throw|else|package|import|case|assert)\b)[\w$.]+(?:<[^()]*>)?(?:\[\])*\s+"
_CPP_TAIL = r"\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|&+|\s)*(?:->[^{;]*)?(?::[^;{]*)?(?:\{|$)"
#: grammar -> (kind, pattern of the code, whose first group is the name); the first that matches counts
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("class", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S+\s+)*fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+(\w+)"), ("class", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")],
    "java": [("class", _JVM_TYPE), ("method", rf"{_JAVA_HEAD}(?:{_JAVA_TYPE})?{_NO_CALL}({_ID})\s*\([^;]*?\)\s*(?:throws\s+[\w., ]+)?\{{"), ("method", rf"{_JAVA_HEAD}{_JAVA_TYPE}{_NO_CALL}({_ID})\s*\([^;=]*\)\s*(?:throws\s+[\w., ]+)?;")],
    "c": [("function", rf"^(?!else\b|return\b)[A-Za-z_][\w\s*]*?[\s*]{_NO_CALL}(\w+)\s*\([^;{{}}]*\)\s*(?:\{{|$)")],
    "cpp": [("class", r"^\s*(?:template\s*<[^{;]*>\s*)?(?:class|struct|union|enum(?:\s+class)?)\s+(\w+)\s*(?:final\s*)?(?::[^;{]*)?(?:\{|$)"), ("function", rf"^\s*(?!else\b|return\b|throw\b|new\b|delete\b)(?:template\s*<[^{{;]*>\s*)?[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_NO_CALL}((?:\w+::)*~?\w+){_CPP_TAIL}"), ("function", rf"^\s*((?:\w+::)+~?\w+){_CPP_TAIL}")],
    "ruby": [("method", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"), ("class", r"^\s*(?:class|module)\s+([\w:]+)")],
    "php": [("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(\w+)")],
    "kotlin": [("function", r"^\s*(?:(?:public|private|protected|internal|override|open|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", _JVM_TYPE)],
    "scala": [("function", r"^\s*(?:(?:private|protected|override|final|implicit)\s+)*def\s+(\w+)"), ("class", _JVM_TYPE)],
    "bash": [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*(?:\{|$)"), ("function", r"^\s*function\s+([\w-]+)\s*(?:\{|$)")],
    "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(")],
}
_SCRIPTS = ("javascript", "typescript", "tsx")
_VERBS = "get|post|put|delete|patch|head|options"
_KEY = ["repo_id", "path"]
_SYMBOL = [*_KEY, "grammar", "kind", "name", "start_line", "end_line"]


def _group(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _defined() -> Column:
    """(kind, name) of the statement's definition, null without one."""
    by_grammar: dict[int, tuple[list, list[str]]] = {}
    for grammar, rows in DEFINITIONS.items():
        by_grammar.setdefault(id(rows), (rows, []))[1].append(grammar)

    def one(kind: str, pattern: str) -> Column:
        return F.when(F.col("code").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.ltrim(_group("code", pattern), F.lit("*")).alias("name")))

    none = F.lit(None).cast("struct<kind:string,name:string>")
    return reduce(lambda rest, x: F.when(F.col("grammar").isin(*x[1]), F.coalesce(*(one(*row) for row in x[0]))).otherwise(rest), by_grammar.values(), none)


def _hit(kind: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit("").alias("name"))


def symbols_of(code: DataFrame) -> DataFrame:
    """``symbols`` of a table of statements."""
    deco = r"^\s*@([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\("
    call = rf"(?i)(?:^|[^\w.$])(?:app|router)\.({_VERBS})\(\s*[\"']([^\"']+)[\"']"
    # a row per hit; the generator also keeps the patterns from being tried again for each use of their result
    hits = F.array(_defined(), F.when((F.col("grammar") == "python") & F.col("code").rlike(r"^\s*@"), _hit("decorator")), F.when(F.col("grammar").isin(*_SCRIPTS) & F.col("code").rlike(call), _hit("call")))
    rows = code.where("code IS NOT NULL").select(*_KEY, "grammar", "line_no", "end_line", "code", "raw", F.inline(F.array_compact(hits)))
    rows = rows.where("kind IN ('decorator', 'call') OR name <> ''")

    # what the texts say is told before the sorts, so that no text is shuffled or buffered
    is_deco, is_call = F.col("kind") == "decorator", F.col("kind") == "call"
    holds = (F.col("kind") == "class") & ((F.col("grammar") != "rust") | F.col("code").rlike(r"^\s*(?:unsafe\s+)?impl\b"))
    listed = F.regexp_extract_all(F.col("raw"), F.lit(r"[\"'](GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)[\"']"), F.lit(1))
    told = {"holds": holds, "object": F.when(is_deco, _group("code", deco)), "verb": F.when(is_deco, _group("code", deco, 2)), "listed": F.when(is_deco, listed)}
    told["route"] = F.when(is_deco & F.col("code").rlike(r"\(.*?[\"']"), F.regexp_extract("raw", r"\(.*?[\"']([^\"']*)[\"']", 1))
    told |= {"called": F.when(is_call, F.upper(_group("raw", call))), "target": F.when(is_call, _group("raw", call, 2))}
    rows = rows.withColumns(told).drop("code", "raw")

    # decorators belong to the next definition below them; one sort down the file and one up
    down = Window.partitionBy(*_KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*_KEY).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"reach": F.max(F.when(F.col("holds"), F.col("end_line"))).over(down), "of": F.last(F.when(~is_deco & ~is_call, F.struct("line_no", "end_line")), ignorenulls=True).over(up)})
    group = Window.partitionBy(*_KEY, "of.line_no")
    is_verb, router = F.col("verb").rlike(rf"^(?:{_VERBS})$"), F.col("object").isin("app", "router", "api", "bp")
    rows = rows.withColumns({"first": F.min("line_no").over(group), "handled": F.max(F.coalesce(is_verb | ((F.col("verb") == "route") & router), F.lit(False))).over(group)})

    kind = F.when((F.col("kind") == "function") & (F.col("reach") >= F.col("end_line")), "method").otherwise(F.col("kind"))
    plain = F.when(~(F.col("handled") & (F.col("kind") == "function")), F.array(F.struct(kind.alias("kind"), "name", F.col("line_no").alias("start_line"), "end_line")))

    def routes(verbs: Column, path: Column, start: str, end: str) -> Column:
        return F.transform(verbs, lambda v: F.struct(F.lit("route").alias("kind"), F.concat(v, F.lit(" "), path).alias("name"), F.col(start).alias("start_line"), F.col(end).alias("end_line")))

    verbs = F.when(is_verb, F.array(F.upper("verb"))).when(F.col("verb") == "route", F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.array(F.lit("GET"))))
    decorated = F.when(F.col("of").isNotNull() & router & F.col("route").isNotNull(), routes(verbs, F.col("route"), "first", "of.end_line"))
    express = routes(F.array("called"), F.col("target"), "line_no", "end_line")
    return rows.select(*_KEY, "grammar", F.inline(F.when(is_deco, decorated).when(is_call, express).otherwise(plain))).select(*_SYMBOL)


def symbols(files: DataFrame) -> DataFrame:
    """repo_id, path, grammar, kind, name, start_line, end_line of functions, classes, methods and routes.

    files: repo_id, path, content.  Spans are of lines, from 1, inclusive.  A function inside a class (in Rust an impl) is a method; a function below a route
    decorator is the route, which spans its decorators too, and no function.  Files without a grammar or content have no rows.
    """
    return symbols_of(statements(files))


def imports_of(code: DataFrame) -> DataFrame:
    """``imports`` of a table of statements."""
    g = F.col("grammar")

    def when(pattern: str, modules: Column) -> Column:
        return F.when(F.col("code").rlike(pattern), modules)

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(F.col("raw"), F.lit(pattern), F.lit(1))

    def first_of(pattern: str) -> Column:
        return F.array(F.trim(_group("raw", pattern)))

    here, named = r"^\s*from\s+(\.+)\s+import\s+\(?\s*(\w+)", r"^\s*from\s+(\.*[A-Za-z_][\w.]*)\s+import\b"
    module, source = r"^\s*import\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)", r"^\s*(?:import|export)\b[^\"';]*?from\s*[\"']([^\"']+)[\"']"
    bare, required = r"^\s*import\s*[\"']([^\"']+)[\"']", r"\brequire\(\s*[\"']([^\"']+)[\"']"
    python = F.coalesce(when(here, F.array(F.concat(_group("raw", here), _group("raw", here, 2)))), when(named, first_of(named)), when(module, first_of(module)))
    script = F.coalesce(when(source, first_of(source)), when(bare, first_of(bare)), when(required, all_of(required)))
    quoted, angled = r"^\s*\#\s*include\s+\"([^\"]+)\"", r"^\s*\#\s*include\s+(<[^>]+>)"
    use, java, kotlin = r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;{]+?)(?:::)?\s*(?:\{[^;]*)?;", r"^\s*import\s+(?:static\s+)?([\w.*]+)", r"^\s*import\s+([\w.*]+)"
    scala, php, ruby = r"^\s*import\s+([\w.]+?)(?:\.?\{.*)?\s*$", r"^\s*use\s+([\w\\]+)", r"^\s*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)[\"']"
    found = (
        F.when(g == "python", python).when(g.isin(*_SCRIPTS), script).when(g.isin("c", "cpp"), F.coalesce(when(quoted, first_of(quoted)), when(angled, first_of(angled))))
        .when(g == "go", when(r"^\s*import\b", all_of(r"\"([^\"]+)\""))).when(g == "rust", when(use, first_of(use))).when(g == "java", when(java, first_of(java))).when(g == "kotlin", when(kotlin, first_of(kotlin)))
        .when(g == "scala", when(scala, first_of(scala))).when(g == "php", when(php, first_of(php))).when(g == "ruby", when(ruby, first_of(ruby)))
    )
    m = F.col("module")
    relative = F.when(g.isin("c", "cpp", "ruby"), True).when(g == "python", m.startswith(".")).when(g.isin(*_SCRIPTS), m.rlike(r"^[./]")).when(g == "rust", m.rlike(r"^(?:crate|super|self)\b")).otherwise(False)
    rows = code.where("code IS NOT NULL").select(*_KEY, "grammar", F.explode(found).alias("module")).where("module <> ''")
    rows = rows.select(*_KEY, "grammar", "module", relative.alias("is_relative"))
    # an import is a small row, but what it may mean is not: its candidates are made where it is dealt to
    return tables.spread(rows, *resolve.IMPORT).dropDuplicates(resolve.IMPORT)


def imports(files: DataFrame) -> DataFrame:
    """repo_id, path, grammar, module, is_relative: each import of a file once."""
    return imports_of(statements(files))


def parse_errors(code: DataFrame) -> DataFrame:
    """repo_id, path, parse_error of files that leave a string, comment or bracket open: failure is data."""
    return code.where("parse_error IS NOT NULL").select(*_KEY, "parse_error")


__all__ = ["DEFINITIONS", "imports", "imports_of", "parse_errors", "statements", "symbols", "symbols_of"]
