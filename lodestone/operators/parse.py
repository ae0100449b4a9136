"""Symbols and imports of source files. Python goes through `ast` (an indentation scanner where that fails); Rust, JavaScript and
TypeScript through a scanner of braces over text whose comments and strings are blanked.

Rules: functions inside functions aren't symbols. Rust: functions, in `impl` blocks scoped by the type as written; structs give none.
Python: functions, classes and their direct functions (Method); decorated ones only outside classes, unless `decorated` is set.
JavaScript and TypeScript: functions, classes with methods, variables that hold a function (the body is the function only)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CALL, language

LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}
SYMBOL = "id string, name string, kind string, file_path string, byte_range struct<start:bigint,end:bigint>, line_range struct<start:bigint,end:bigint>, body string, calls array<string>, parent_scope string, ordinal bigint"
IMPORT = "file_path string, module_path string, imported_names array<string>"


class Parsed:
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path
        self.symbols: list[dict] = []
        self.imports: list[dict] = []

    def symbol(self, name: str, kind: str, begin: int, end: int, scope: str | None = None) -> None:
        """One symbol; begin and end count characters, the stored ranges bytes and lines from 0."""
        body = self.source[begin:end]
        first = self.source.count("\n", 0, begin)
        at = len(self.source[:begin].encode())
        called = sorted({m for m in re.findall(CALL, body)} - {name})
        self.symbols.append({
            "id": "::".join(x for x in (self.path, scope, name) if x), "name": name, "kind": kind, "file_path": self.path,
            "byte_range": {"start": at, "end": at + len(body.encode())}, "line_range": {"start": first, "end": first + body.count("\n")},
            "body": body, "calls": called, "parent_scope": scope, "ordinal": len(self.symbols),
        })

    def imported(self, text: str) -> None:
        self.imports.append({"file_path": self.path, "module_path": text, "imported_names": []})


def _python(out: Parsed, decorated: bool) -> None:
    try:
        tree = ast.parse(out.source)
    except (SyntaxError, ValueError):
        return _python_by_indent(out)
    starts = [0]
    for line in out.source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = out.source.split("\n")
    place = lambda line, column: starts[line - 1] + len(raw[line - 1].encode()[:column].decode(errors="ignore"))
    span = lambda n: (place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset))
    is_function = lambda n: isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))

    def class_(node: ast.ClassDef, scope: str | None) -> None:
        out.symbol(node.name, "class", *span(node), scope)
        for child in node.body:
            if getattr(child, "decorator_list", None) and not decorated:
                continue
            if is_function(child):
                out.symbol(child.name, "method", *span(child), node.name)
            elif isinstance(child, ast.ClassDef):
                class_(child, node.name)

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if is_function(child):
                out.symbol(child.name, "function", *span(child))
            elif isinstance(child, ast.ClassDef):
                class_(child, None)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.imported(out.source[slice(*span(child))])
            else:
                walk(child)

    walk(tree)


def _python_by_indent(out: Parsed) -> None:
    lines, at = out.source.split("\n"), 0
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    depth = lambda s: len(s) - len(s.lstrip())
    scopes: list[tuple[int, str, str]] = []  # indent, kind, name
    for k, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if not line.strip():
            continue
        while scopes and depth(line) <= scopes[-1][0]:
            scopes.pop()
        if re.match(r"\s*(import|from)\s", line) and not scopes:
            out.imported(line.strip())
        if not m:
            continue
        inner = scopes[-1] if scopes else None
        if not (inner and inner[1] == "def"):
            end = k + 1
            while end < len(lines) and (not lines[end].strip() or depth(lines[end]) > depth(line)):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            scope = inner[2] if inner else None
            out.symbol(m[3], "class" if m[2] == "class" else "method" if scope else "function", starts[k] + depth(line), starts[end - 1] + len(lines[end - 1]), scope)
        scopes.append((depth(line), m[2], m[3]))


def blanked(source: str, lang: str) -> str:
    """The source with comments and the contents of strings replaced by blanks: same length, same lines."""
    strings = r'"(?:\\.|[^"\\])*"'
    if lang == "rust":
        strings = r'r(#*)".*?"\1|' + strings + r"|'(?:\\.[^']*|[^'\\])'"
    else:
        strings += r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(rf"(?s)//[^\n]*|/\*.*?\*/|{strings}", lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The place after the bracket that closes the one at `at` (the end of the text if none does)."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def _rust(out: Parsed) -> None:
    text = blanked(out.source, "rust")
    head = re.compile(r"(?P<fn>(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+))|(?P<impl>\bimpl\b)|(?P<use>(?:pub(?:\s*\([^)]*\))?\s+)?\buse\s+[^;]+;)")

    def body_of(at: int, stop: int) -> int:
        """Place of the brace that opens the body, or -1 where a semicolon ends the item first."""
        m = re.compile(r"[{;]").search(text, closing(text, text.find("(", at), "()") if "(" in text[at:stop] else at, stop)
        return m.start() if m and m[0] == "{" else -1

    def walk(at: int, stop: int, scope: str | None) -> None:
        while m := head.search(text, at, stop):
            at = m.end()
            if m["use"]:
                out.imported(re.sub(r"^use ", "", out.source[m.start() : m.end()].strip()).rstrip(";").strip())
            elif m["fn"]:
                brace = body_of(m.end(), stop)
                if brace >= 0:
                    at = closing(text, brace)
                    out.symbol(m["name"], "function", m.start(), at, scope)
            else:
                brace = text.find("{", m.end(), stop)
                if brace < 0:
                    return
                header = out.source[m.end() : brace]
                if header.lstrip().startswith("<"):
                    header = header[closing(header, header.find("<"), "<>") :]
                kind = re.split(r"\bwhere\b", re.split(r"\sfor\s", header)[-1])[0].strip()
                at = closing(text, brace)
                walk(brace + 1, at - 1, kind)

    walk(0, len(text), None)


def _script(out: Parsed, lang: str) -> None:
    text = blanked(out.source, lang)
    head = re.compile(r"(?P<function>\b(?:async\s+)?function\s+(?P<fname>[\w$]+))|(?P<class>\bclass\s+(?P<cname>[\w$]+))|(?P<variable>\b(?:const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=;\n]+)?=\s*)|(?P<import>^[ \t]*import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?)", re.M)
    method = re.compile(r"(?:\b(?:static|async|public|private|protected|readonly|get|set|override)\s+)*(?P<name>[#\w$]+)\s*(?:<[^>(]*>)?\((?=[^;]*?\{)")

    def value_end(at: int) -> int:
        """End of the function that stands at `at`, or -1."""
        m = re.compile(r"(?:async\s+)?(?:(function)\b[^(]*|[\w$]+\s*(=>)|)").match(text, at)
        if m[1]:
            brace = text.find("{", closing(text, text.find("(", at), "()"))
            return closing(text, brace) if brace >= 0 else -1
        at = m.end()
        if not m[2]:
            if text[at : at + 1] != "(":
                return -1
            arrow = re.compile(r"\s*(?::[^=;{]*)?=>").match(text, closing(text, at, "()"))
            if not arrow:
                return -1
            at = arrow.end()
        rest = re.compile(r"\s*").match(text, at).end()
        if text[rest : rest + 1] == "{":
            return closing(text, rest)
        depth = 0
        for i in range(rest, len(text)):
            depth += (text[i] in "([{") - (text[i] in ")]}")
            if depth < 0 or not depth and text[i] in ";\n":
                return i
        return len(text)

    at = 0
    while m := head.search(text, at):
        at = m.end()
        if m["import"]:
            out.imported(out.source[m.start() : m.end()].strip())
        elif m["function"]:
            brace = text.find("{", closing(text, text.find("(", m.end()), "()"))
            at = closing(text, brace) if brace >= 0 else len(text)
            out.symbol(m["fname"], "function", m.start(), at)
        elif m["class"]:
            brace = text.find("{", m.end())
            at = closing(text, brace) if brace >= 0 else len(text)
            out.symbol(m["cname"], "class", m.start(), at)
            inner = brace + 1
            while 0 < inner < at and (f := method.search(text, inner, at)):
                open_ = text.find("{", closing(text, text.find("(", f.start("name")), "()"), at)
                if open_ < 0:
                    break
                inner = closing(text, open_)
                out.symbol(f["name"], "method", f.start(), inner, m["cname"])
        elif (end := value_end(m.end())) >= 0:
            out.symbol(m["vname"], "function", m.end(), end)
            at = end


def parse_source(source: str, path: str, decorated: bool = False) -> Parsed:
    """Symbols and imports of one file; nothing for an unknown extension."""
    out = Parsed(source, path)
    lang = LANGUAGES.get(path.rsplit("/", 1)[-1].rpartition(".")[2])
    if lang == "python":
        _python(out, decorated)
    elif lang == "rust":
        _rust(out)
    elif lang:
        _script(out, lang)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """All symbol rows of a frame (path, content string); files that aren't text or of no known language give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [s for path, content in zip(batch["path"], batch["content"], strict=True) for s in parse_source(content, path).symbols]
            yield pd.DataFrame(rows, columns=["id", "name", "kind", "file_path", "byte_range", "line_range", "body", "calls", "parent_scope", "ordinal"])

    return files.where(language(F.col("path")).isNotNull() & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, SYMBOL)


def imports(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [s for path, content in zip(batch["path"], batch["content"], strict=True) for s in parse_source(content, path).imports]
            yield pd.DataFrame(rows, columns=["file_path", "module_path", "imported_names"])

    return files.where(language(F.col("path")).isNotNull() & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, IMPORT)


def skeleton(body: str | None) -> str:
    """The signature (up to six lines, to a brace or a final colon) and the docstring or comment block (up to 14 lines) after it."""
    lines = (body or "").split("\n")
    k = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    head: list[str] = []
    for line in lines[k : k + 6]:
        head.append(line)
        if "{" in line or line.rstrip().endswith(":"):
            break
    k += len(head)
    while k < len(lines) and not lines[k].strip():
        k += 1
    note: list[str] = []
    first = lines[k].strip() if k < len(lines) else ""
    quote = first[:3] if first[:3] in ('"""', "'''") else None
    for line in lines[k : k + 14]:
        bare = line.strip()
        if quote is None and not bare.startswith(("#", "//", "/*", "*")):
            break
        note.append(line)
        if quote and (bare.endswith(quote) and (len(note) > 1 or len(bare) >= 6)):
            break
    return "\n".join(head + ([""] + note if note else [])).rstrip()


def with_skeleton(frame: DataFrame, body: str = "body") -> DataFrame:
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(skeleton)

    run.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    return frame.withColumn("skeleton", F.pandas_udf(run, "string")(body))
