"""Symbols of brace languages with their true ends: functions, methods and types, also nested ones.

A lexer skips comments, strings, characters and regular expressions and keeps a stack of open braces. What stands before
a brace since the last statement or brace says what it opens: a type, a function, a method of a type, or just a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of files that are read in this way.
LANGUAGES = ["js", "ts", "jsx", "tsx", "cjs", "mjs", "go", "rs", "java", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "swift"]
_TYPES = {"class", "interface", "struct", "enum", "trait", "impl", "namespace", "mod", "record", "union"}
_FUNCTIONS = {"function", "func", "fn", "fun"}
_CONTROL = {"if", "for", "while", "switch", "catch", "else", "do", "try", "return", "new", "match", "loop", "with", "synchronized", "select", "when", "throw", "await", "typeof", "unsafe", "case"}
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])'|(?<![\w.])r\#+".*?"\#+|\w+|=>|->|::|[{}()\[\];=,:<>*&]|\n|[^\s\w]""", re.S)
_PLAIN = re.compile(r"'(?:\\.|[^'\\\n])*'")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_GO_ON = {"extends", "implements", "where", "throws"}
_SCRIPTS = {"js", "ts", "jsx", "tsx", "cjs", "mjs"}


def _template(text: str, at: int) -> int:
    """The end of a template string that begins before `at`; ${...} may hold others."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "`":
            if not depth:
                return at + 1
            at = _template(text, at + 1)
            continue
        if c == "$" and text[at + 1 : at + 2] == "{" and not depth:
            depth, at = 1, at + 2
            continue
        depth += depth and (c == "{") - (c == "}")
        at += 1
    return at


def tokens(text: str, script: bool) -> Iterator[tuple[str, int]]:
    """What counts of the text: words and signs, each with its line. Strings stand as one sign."""
    at, line, last = 0, 1, ""
    while at < len(text):
        m = None
        if script and text[at] == "`":
            end = _template(text, at + 1)
        elif script and text[at] == "/" and (not last or last in "=(,:[!&|?{};" or last in ("return", "typeof", "case", "=>")) and (m := _REGEX.match(text, at)):
            end = m.end()
        elif script and text[at] == "'" and (m := _PLAIN.match(text, at)):
            end = m.end()
        elif m := _TOKEN.match(text, at):
            end = m.end()
        else:
            at += 1
            continue
        word = text[at:end]
        if word.startswith(("//", "/*")):
            pass
        elif word == "\n":
            yield word, line
        elif word[0] in "\"'`" and len(word) > 1 or word.startswith("r#") or (m and m.re is _REGEX):
            yield "str", line
            last = "str"
        else:
            yield word, line
            last = word
        line += word.count("\n")
        at = end


def opened(head: list[str], inside: str) -> tuple[str, str] | None:
    """The kind and name of what a brace after these words opens; None for a block. inside: the kind of what it stands in."""
    word = lambda i: i < len(head) and re.match(r"[^\W\d]", head[i]) is not None
    depth, outer = 0, []  # places outside all brackets
    for i, t in enumerate(head):
        depth -= t in ")]"
        if depth <= 0 and t not in ")]":
            outer.append(i)
        depth += t in "(["
    for i in reversed(range(len(head))):
        if head[i] in _FUNCTIONS:
            j = i + 1
            if j < len(head) and head[j] == "(" and head[i] == "func":  # a receiver, if a name and parameters follow
                j = next((k + 1 for k in range(j, len(head)) if head[k] == ")"), len(head))
                if not word(j) or head[j + 1 : j + 2] != ["("]:
                    j = len(head)
            while j < len(head) and head[j] == "*":
                j += 1
            if word(j):
                return "function", head[j]
            name = next((k - 1 for k in reversed(range(i)) if head[k] in ("=", ":") and word(k - 1)), None)
            return None if name is None else ("function", head[name])
    for i in outer:
        if head[i] in _TYPES and not (i and head[i - 1] in (".", "::")):
            if i and head[i] in ("struct", "interface") and i >= 2 and head[i - 2] == "type":
                return head[i], head[i - 1]
            names = [head[k] for k in outer if k > i and word(k)]
            if head[i] == "impl" and "for" in names:
                return "impl", names[names.index("for") + 1] if names[-1] != "for" else names[0]
            return (head[i], names[0]) if names else None
    if head and head[-1] == "=>":
        equal = [i for i in range(len(head)) if head[i] in ("=", ":")]
        return ("function", next((head[k - 1] for k in equal if word(k - 1)), "")) if equal and word(equal[0] - 1) else None
    for i in outer:
        if i + 1 < len(head) and head[i + 1] == "(" and word(i):
            if head[i] in _CONTROL or (i and (head[i - 1] in (".", "=", "(", ",") or head[i - 1] in _CONTROL)):
                return None
            return ("method" if inside in _TYPES else "function", head[i]) if inside in _TYPES or inside == "" else None
    return None


def symbols_of(text: str, script: bool = True, lines: bool | None = None) -> list[tuple[str, str, int, int, int]]:
    """(symbol, kind, start_line, end_line, depth): symbols in the order in which they begin; a nested one has its holders' names before its own. What is never closed ends with the text.
    lines: a statement may end with its line (scripts and Go), without a sign."""
    lines = script if lines is None else lines
    stack: list[tuple[str, str, int, int] | None] = []  # kind, name, line, place in out
    out: list[list] = []
    head: list[tuple[str, int]] = []
    held: list[list[tuple[str, int]]] = []  # what stood before the braces that are open
    broken = False
    for t, line in tokens(text, script):
        if t == "\n":
            broken = broken or bool(lines and head and re.match(r"[\w)\]]", head[-1][0]) and sum(w in "([" for w, _ in head) <= sum(w in ")]" for w, _ in head))
            continue
        if broken and re.match(r"[\w@}]", t) and t not in _GO_ON:
            head = []
        broken = False
        if t == "{":
            inside = next((s[0] for s in reversed(stack) if s), "") if not stack or stack[-1] else "block"
            found = opened([w for w, _ in head], inside)
            if found:
                names = [s[1] for s in stack if s] + [found[1]]
                out.append([".".join(names), found[0], head[0][1], line, len(names)])
                stack.append((*found, line, len(out) - 1))
            else:
                stack.append(None)
            held.append(head)
            head = []
        elif t == "}":
            if stack:
                if top := stack.pop():
                    out[top[3]][3] = line
                before = held.pop()
                open_ = sum(w == "(" for w, _ in before) - sum(w == ")" for w, _ in before)
                head = before if open_ > 0 and not top else [] if open_ <= 0 else [w for w in before if w[0] == "("][:open_]
            else:
                head = []
        elif t == ";":
            if sum(w == "(" for w, _ in head) <= sum(w == ")" for w, _ in head):
                head = []
        else:
            head.append((t, line))
    last = text.count("\n") + 1
    for s in stack:
        if s:
            out[s[3]][3] = last
    return [tuple(r) for r in out]


def nested_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, start_line, end_line, depth) of files (path, text) of brace languages; others and null texts have none."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = files.select("path", "text", ending.alias("ending")).where(F.col("text").isNotNull() & F.col("ending").isin(LANGUAGES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text, ending in zip(*(b.column(c).to_pylist() for c in ("path", "text", "ending")), strict=True):
                found = list(zip(*symbols_of(text, ending in _SCRIPTS, ending in _SCRIPTS or ending in ("go", "kt", "swift")), strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found[0]), pa.string()), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=["path", "symbol", "kind", "start_line", "end_line", "depth"])

    return rows.mapInArrow(cut, "path string, symbol string, kind string, start_line int, end_line int, depth int")
