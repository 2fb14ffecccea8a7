"""Statements of source files: which text is code, which lines belong together, and where the block that a statement opens ends.

One pass over each file as its row streams by, in time linear in its length.  Strings and comments are regular, so one pattern per family of
grammars finds them all from left to right; a stack holds the open brackets (for Python and Ruby also the open indentations).  Nothing is
shuffled, and what a statement means is decided by columns (``structure``), not here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetables.functions import languages

_LONG = r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*(?:"""|\Z)'
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_SLASHED = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n])|(?<=[=(,:;!&|?{}\[] )|(?<=\breturn ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/"
#: family -> (strings, comments); a character literal of Rust needs its end, since 'a also names a lifetime.
_LEXICON = {
    "python": (rf"{_LONG}|{_LONG.replace(chr(34), chr(39))}|{_DOUBLE}|{_SINGLE}", r"\#[^\n]*"),
    "javascript": (rf"`[^`\\]*(?:\\.[^`\\]*)*(?:`|\Z)|{_DOUBLE}|{_SINGLE}|{_REGEX}", _SLASHED),
    "go": (rf"`[^`]*(?:`|\Z)|{_DOUBLE}|{_SINGLE}", _SLASHED),
    "rust": (r'\br(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z)|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|' + r"'(?:\\[^\n]{1,9}?|[^\\'\n])'", _SLASHED),
    "c": (rf"{_DOUBLE}|{_SINGLE}", _SLASHED),
    "jvm": (rf"{_LONG}|{_DOUBLE}|{_SINGLE}", _SLASHED),
    "php": (r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|' + r"'[^'\\]*(?:\\.[^'\\]*)*(?:'|\Z)", rf"{_SLASHED}|\#(?!\[)[^\n]*"),
    "ruby": (rf"{_DOUBLE}|{_SINGLE}", r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|\#(?!\{)[^\n]*"),
    "bash": (r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|' + r"'[^']*(?:'|\Z)", r"(?:^|(?<=\s))\#[^\n]*"),
    "r": (r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z)|' + r"'[^'\\]*(?:\\.[^'\\]*)*(?:'|\Z)", r"\#[^\n]*"),
}
_FAMILY = {"python": "python", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "go": "go", "rust": "rust", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm", "scala": "jvm", "php": "php", "ruby": "ruby", "bash": "bash", "r": "r"}
#: Grammars whose blocks end by indentation, not by braces.
INDENTED = ("python", "ruby")
#: Statements that go on over a brace: lists of imported names.
_NAMES = {"javascript": r"\s*(?:import|export)\b(?:\s+type)?\s*(?:[\w$]+\s*,\s*)?\{[^}]*$", "rust": r"\s*(?:pub(?:\([^)]*\))?\s+)?use\b[^;]*\{[^}]*$", "jvm": r"\s*import\b[^{]*\{[^}]*$", "php": r"\s*use\b[^{]*\{[^}]*$"}
#: Heads that go on over lines without a bracket until one of ; { } ends them (Java: all statements, so annotations belong to what they stand before).
_HEADS = {
    **dict.fromkeys(("javascript", "typescript", "tsx"), r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b"), "java": r"", "php": r"\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\b",
    "rust": r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*(?:fn|impl|struct|enum|trait)\b", **dict.fromkeys(("c", "cpp"), r"\s*(?:class|struct|union|enum)\b|(?!else\b|do\b)[A-Za-z_][\w \t*&]*$"),
}
#: Lines that continue the head before them.
_TAILS = {"kotlin": r"\s*(?::|where\b)", "scala": r"\s*(?:extends|with)\b", "cpp": r"\s*:(?!:)"}
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
_LEXERS: dict = {}
#: Statements in a batch, and characters of the files that share one.
ROWS, CHARS = 10_000, 4 << 20


def _lexer(family: str) -> tuple[re.Pattern, re.Pattern | None]:
    if family not in _LEXERS:
        strings, comments = _LEXICON[family]
        brackets = r"[{}]" if family == "bash" else r"[(\[{}\])]"  # a case label of bash has a bracket of its own
        _LEXERS[family] = re.compile(rf"(?P<comment>{comments})|(?P<string>{strings})|(?P<bracket>{brackets})", re.S | re.M), re.compile(_NAMES[family]) if family in _NAMES else None
    return _LEXERS[family]


def _blank(text: str, fill: str) -> str:
    return re.sub(r"[^\n]", fill, text)


def masked(source: str, grammar: str) -> tuple[list[str], list[list[str]], set[int], str | None]:
    """(lines with comments as spaces and insides of strings as _, brackets of each line, lines that begin inside a string, what is left open)."""
    lexer, _ = _lexer(_FAMILY[grammar])
    out, at, line, error = [], 0, 0, None
    brackets: list[list[str]] = [[]]
    inside = set()
    for m in lexer.finditer(source):
        between = source[at : m.start()]
        out.append(between)
        token, at = m.group(), m.end()
        more = between.count("\n")
        brackets.extend([] for _ in range(more))
        line += more
        if m.lastgroup == "bracket":
            brackets[line].append(token)
            out.append(token)
            continue
        comment = m["comment"] is not None
        if comment:
            out.append(_blank(token, " "))
            if at == len(source) and token.startswith("/*") and not (token.endswith("*/") and len(token) > 3):
                error = f"line {line + 1}: comment without an end"
        else:
            quote = re.match(r"\w*\#*(\"\"\"|'''|[\"'`/])", token).group(0)
            long = "\n" in token or len(quote) > 2
            end = quote[::-1].removesuffix("r") if quote[0] == "r" else quote
            if long and at == len(source) and (len(token) < 2 * len(end) or not token.endswith(end)):
                error = f"line {line + 1}: string without an end"
            out.append(quote + _blank(token[len(quote) : -len(end)], "_") + token[max(len(quote), len(token) - len(end)) :] if len(token) >= len(quote) + len(end) else token)
        more = token.count("\n")
        if more:
            brackets.extend([] for _ in range(more))
            if not comment:
                inside.update(range(line + 1, line + more + 1))
            line += more
    rest = source[at:]
    out.append(rest)
    brackets.extend([] for _ in range(rest.count("\n")))
    return "".join(out).split("\n"), brackets, inside, error


def file_statements(source: str, grammar: str) -> tuple[list[tuple], str | None]:
    """([(line_no, last_line, end_line, indent, code, raw)], parse_error) of one file; lines count from 1.

    code is the statement with comments and the insides of strings masked, its lines joined by spaces, raw the same as it is written.
    end_line is where the first bracket that the statement leaves open is closed, or its indented block ends; else its own last line.
    """
    source = re.sub(r"\r\n?", "\n", source)
    heads, tails = (re.compile(t[grammar]) if grammar in t else None for t in (_HEADS, _TAILS))
    family, indented = _FAMILY[grammar], grammar in INDENTED
    names = _lexer(family)[1]
    lines, brackets, inside, error = masked(source, grammar)
    raw = source.split("\n")
    found: list[list] = []  # line_no, last_line, end_line, indent
    stack: list[tuple] = []  # open brackets: the bracket, its statement, statements whose block it holds, its line
    n_open = dict.fromkeys(_CLOSED_BY.values(), 0)
    blocks: list[tuple[int, int]] = []  # open indentations: indent, statement
    now, filled, lists_names, is_head, tail = None, 0, False, False, ""
    for n, text in enumerate(lines):
        if now is None:
            if not text.strip():
                continue
            now, lists_names, is_head = len(found), bool(names and names.match(text)), bool(heads and heads.match(text))
            indent = len(text) - len(text.lstrip())
            found.append([n + 1, n + 1, None, indent])
            if indented:
                while blocks and blocks[-1][0] > indent:
                    found[blocks.pop()[1]][2] = filled
                if blocks and blocks[-1][0] == indent:
                    closes = grammar == "ruby" and re.match(r"\s*end\b", text)
                    found[blocks.pop()[1]][2] = n + 1 if closes else filled
                blocks.append((indent, now))
        first = text.lstrip()[:1] == "{" and n + 1 == found[now][0]
        for b in brackets[n]:
            if b in _CLOSED_BY:
                owners = []
                if first and now and found[now - 1][2] is None and lines[found[now - 1][1] - 1].rstrip()[-1:] not in (";", "}"):
                    owners = [now - 1]  # the brace of a head on the line before
                stack.append((b, now, owners, n + 1))
                n_open[_CLOSED_BY[b]] += 1
                first = False
                continue
            if not stack or _CLOSED_BY[stack[-1][0]] != b:
                error = error or f"line {n + 1}: unexpected {b}"
            if n_open[b]:
                while True:  # what was left open inside ends unseen
                    opened, _, owners, _ = stack.pop()
                    n_open[_CLOSED_BY[opened]] -= 1
                    if _CLOSED_BY[opened] == b:
                        break
                for owner in owners:
                    found[owner][2] = n + 1
        if text.strip() or n in inside:
            found[now][1] = filled = n + 1
            tail = text.rstrip()[-1:]
        in_brackets = stack and (grammar == "python" or stack[-1][0] != "{" or (lists_names and stack[-1][1] == now))
        goes_on = in_brackets or n + 1 in inside or (text.endswith("\\") and family in ("python", "c", "bash"))
        goes_on = goes_on or (is_head and tail not in (";", "{", "}", ":"))
        if not goes_on and tails and tail == ")" and tails.match(next((x for x in lines[n + 1 : n + 100] if x.strip()), "")):
            goes_on = is_head = True
        if goes_on and n + 1 < len(lines):
            continue
        if not indented and stack and stack[-1][1] == now:
            k = len(stack)
            while k and stack[k - 1][1] == now:
                k -= 1
            stack[k][2].append(now)
        now = None
    if stack:
        error = error or f"line {stack[-1][3]}: {stack[-1][0]} without an end"
    left_open = set(range(len(found))) if indented else {k for x in stack for k in x[2]}
    out = []
    for k, (line, last, end, indent) in enumerate(found):
        end = filled if end is None and k in left_open else end or last
        out.append((line, last, max(last, end), indent, " ".join(lines[line - 1 : last]), " ".join(raw[line - 1 : last])))
    return out, error


#: The columns of statements.
_COLUMNS = [("repo_id", pa.string()), ("path", pa.string()), ("grammar", pa.string()), ("line_no", pa.int32()), ("last_line", pa.int32()), ("end_line", pa.int32()), ("indent", pa.int32()), ("code", pa.string()), ("raw", pa.string()), ("parse_error", pa.string())]


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of batches of repo_id, path, grammar, content; small files share a batch, which costs more to make than such a file does to scan."""

    def made(table: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(table), ROWS):
            part = table[at : at + ROWS]
            yield pa.record_batch([pa.array([r[k] for r in part], t) for k, (_, t) in enumerate(_COLUMNS)], [n for n, _ in _COLUMNS])

    table, chars = [], 0
    for batch in batches:
        for repo, path, grammar, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, error = file_statements(content, grammar)
            table.extend((repo, path, grammar, *s, None) for s in found)
            chars += len(content)
            if error:
                table.append((repo, path, grammar, None, None, None, None, None, None, error))
            if len(table) >= ROWS or chars >= CHARS:
                yield from made(table)
                table, chars = [], 0
    yield from made(table)


def statements(files: DataFrame) -> DataFrame:
    """repo_id, path, grammar, line_no, last_line, end_line, indent, code, raw of the files that have a grammar and content.

    A file that leaves a string, comment or bracket open, or closes one too many, has one more row without code: parse_error says where.
    """
    rows = files.select(F.col("repo_id").cast("string").alias("repo_id"), F.col("path").cast("string").alias("path"), languages.grammar(F.col("path")).alias("grammar"), F.col("content").cast("string").alias("content")).where("grammar IS NOT NULL AND content IS NOT NULL")
    return rows.mapInArrow(scanned, "repo_id string, path string, grammar string, line_no int, last_line int, end_line int, indent int, code string, raw string, parse_error string")
