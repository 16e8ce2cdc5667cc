"""Source text to rows of nodes.

Python is parsed by its own grammar. The other languages have no parser here: their declarations, imports and calls
are read by patterns over text without comments and strings, and spans end at the matching brace. That finds what
well-formatted code declares; it is approximate where code hides braces or generates declarations.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators.registry import Registry

NODES = (
    "id string, file_path string, language string, node_type string, name string, qualified_name string, start_line int, end_line int, "
    "start_column int, end_column int, parent_id string, signature string, docstring string, annotations array<struct<name:string,args:array<string>>>, error string"
)
_COLUMNS = [p.split()[0] for p in NODES.split("annotations")[0].rstrip(", ").split(", ")] + ["annotations", "error"]
MAX_CHARS = 10 * 1024 * 1024


def _row(path, lang, kind, name, qualified, span, parent=None, signature=None, doc=None, annotations=(), error=None):
    start, end, column, end_column = span
    key = "\0".join(map(str, (path, kind, name, start, end, column)))
    return (hashlib.sha256(key.encode()).hexdigest()[:32], path, lang, kind, name, qualified, start, end, column, end_column, parent, signature, doc, [{"name": n, "args": list(a)} for n, a in annotations], error)


def parse_python(path: str, text: str) -> list[tuple]:
    """Functions, methods, classes, protocols, enums, imports and calls."""
    module = path.removesuffix(".py").replace("/", ".")
    rows: list[tuple] = []
    span = lambda n: (n.lineno, n.end_lineno, n.col_offset, n.end_col_offset)

    def annotation(node):
        call = node if isinstance(node, ast.Call) else None
        args = [ast.unparse(a) for a in call.args] + [f"{k.arg}={ast.unparse(k.value)}" for k in call.keywords] if call else []
        return "@" + ast.unparse(call.func if call else node), args

    def visit(node, names, parent, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = [*names, child.name]
                if isinstance(child, ast.ClassDef):
                    bases = [ast.unparse(b).rsplit(".", 1)[-1].split("[")[0] for b in child.bases]
                    kind = "protocol" if "Protocol" in bases else "enum" if any(b.endswith("Enum") for b in bases) else "class"
                    signature = f"class {child.name}({', '.join(map(ast.unparse, child.bases))})" if child.bases else f"class {child.name}"
                else:
                    kind = "method" if in_class else "function"
                    returns = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                    signature = f"def {child.name}({ast.unparse(child.args)}){returns}"
                row = _row(path, "python", kind, child.name, ".".join([module, *inner]), span(child), parent, signature, ast.get_docstring(child), [annotation(d) for d in child.decorator_list])
                rows.append(row)
                visit(child, inner, row[0], isinstance(child, ast.ClassDef))
                continue
            if isinstance(child, ast.Import):
                rows.extend(_row(path, "python", "import", a.name, a.asname, span(child), parent) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.append(_row(path, "python", "import", "." * child.level + (child.module or ""), None, span(child), parent))
            elif isinstance(child, ast.Call):
                if isinstance(child.func, ast.Attribute):
                    rows.append(_row(path, "python", "call", f"*.{child.func.attr}", ast.unparse(child.func), span(child), parent))
                elif isinstance(child.func, ast.Name):
                    rows.append(_row(path, "python", "call", child.func.id, child.func.id, span(child), parent))
            visit(child, names, parent, in_class)

    visit(ast.parse(text), [], None, False)
    return rows


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "new", "super", "import", "typeof", "await", "else", "throw", "synchronized"}
_SCRIPT = [
    ("import", r"^[ \t]*import\b[^'\"\n;]*['\"](?P<name>[^'\"]+)['\"]"), ("import", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)"),
    ("class", r"\bclass\s+(?P<name>\w+)[^{;]*\{"), ("function", r"\bfunction\s*\*?\s*(?P<name>\w+)\s*\([^)]*\)[^{;]*\{"),
    ("function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>\s*\{?"),
    ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{"),
    ("object_method", r"\b(?P<name>\w+)\s*:\s*(?:async\s+)?(?:function\b\s*)?\([^)\n]*\)\s*(?:=>\s*)?\{"),
]
#: Patterns of declarations per language: (node type, pattern with a group `name`).
PATTERNS = {
    "javascript": _SCRIPT,
    "typescript": [*_SCRIPT, ("interface", r"\binterface\s+(?P<name>\w+)[^{;]*\{"), ("type", r"\btype\s+(?P<name>\w+)(?:<[^=]*>)?\s*="), ("enum", r"\benum\s+(?P<name>\w+)\s*\{"), ("jsx_element", r"<(?P<name>[A-Z]\w*)[\s/>]")],
    "java": [
        ("import", r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"), ("class", r"\bclass\s+(?P<name>\w+)[^{;]*\{"), ("interface", r"\binterface\s+(?P<name>\w+)[^{;]*\{"), ("enum", r"\benum\s+(?P<name>\w+)[^{;]*\{"),
        ("constructor", r"^[ \t]+(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*\([^)]*\)[^{;]*\{"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^)]*\)[^{;=]*\{"),
    ],
    "go": [
        ("import", r"^[ \t]*(?:import\s+)?(?:[\w.]+[ \t]+)?\"(?P<name>[\w./-]+)\"[ \t]*$"), ("struct", r"\btype\s+(?P<name>\w+)\s+struct\s*\{"), ("interface", r"\btype\s+(?P<name>\w+)\s+interface\s*\{"),
        ("method", r"^func\s*\((?P<owner>[^)]*)\)\s*(?P<name>\w+)\s*\([^{\n]*\{"), ("function", r"^func\s+(?P<name>\w+)\s*[(\[][^{\n]*\{"),
    ],
}
_SPACE = re.compile(r"\s*")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(")
_ANNOTATION = re.compile(r"@(?P<name>[\w.]+)(?:\((?P<args>[^()]*)\))?\s*$")


def _ends_of_blocks(bare: str) -> dict[int, int]:
    """Place after the matching brace of every opening one that has any: one pass with a stack."""
    ends, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends


def parse_by_pattern(path: str, lang: str, text: str) -> list[tuple]:
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    bare = _BLANK.sub(keep, text)
    uncommented = re.sub(r"//[^\n]*|/\*.*?\*/", keep, text, flags=re.S)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    from bisect import bisect_right

    def place(i):
        line = bisect_right(starts, i)
        return line, i - starts[line - 1]

    package = re.search(r"^\s*package\s+([\w.]+)", bare, re.M)
    found, ends, lines = [], _ends_of_blocks(bare), text.split("\n")
    for kind, pattern in PATTERNS[lang]:
        source = uncommented if kind == "import" else bare
        for m in re.finditer(pattern, source, re.M):
            name = m["name"]
            if kind in ("method", "object_method", "constructor") and name in _WORDS:
                continue
            end = ends.get(m.end() - 1, len(bare)) if m[0].endswith("{") else m.end()
            owner = re.sub(r"^.*[\s*]|\*", "", (m.groupdict().get("owner") or "").strip())
            found.append((m.start("name"), end, kind, name, owner, text[m.start() : m.end()].strip().rstrip("{").strip(), m.start()))
    found.sort(key=lambda x: (x[6], -x[1]))
    rows, stack, seen = [], [], set()
    calls = [(m.start("name"), m.end(), m) for m in _CALL.finditer(bare)]
    declared = {x[0] for x in found}
    items = [(x[6], 0, x) for x in found] + [(c[0], 1, c) for c in calls if c[0] not in declared]
    for at, what, item in sorted(items, key=lambda x: x[:2]):
        while stack and stack[-1][0] <= at:
            stack.pop()
        parent = stack[-1][1] if stack else None
        if what:
            start, end, m = item
            name = re.sub(r"\s", "", m["name"])
            if name.split(".")[-1] in _WORDS or name in _WORDS:
                continue
            short = f"new {name}" if m["new"] else f"*.{name.rsplit('.', 1)[-1]}" if "." in name else name
            line, column = place(start)
            close = text.find(")", end)
            whole = text[start : close + 1 if 0 <= close < start + 300 else end]
            rows.append(_row(path, lang, "call", short, whole.split("\n")[0], (line, place(end)[0], column, place(end)[1]), parent))
            continue
        start, end, kind, name, owner, signature, first = item
        if (start, name) in seen:
            continue
        seen.add((start, name))
        owners = [s[2] for s in stack if s[3] in ("class", "interface", "struct", "enum")]
        names = [*owners, *([owner] if owner else []), name]
        stem = re.sub(r"\.\w+$", "", path)
        qualified = {"java": ".".join([*([package[1]] if package else []), *names]), "go": f"{package[1] if package else ''}:{'.'.join(names)}"}.get(lang, f"{stem}:{'.'.join(names)}")
        line, column = place(_SPACE.match(text, first).end())
        above, annotations = line - 2, []
        while above >= 0 and not lines[above]:
            above -= 1
        while above >= 0 and (m := _ANNOTATION.search(lines[above].strip())) and lines[above].strip().startswith("@"):
            annotations.insert(0, ("@" + m["name"], [a.strip() for a in (m["args"] or "").split(",") if a.strip()]))
            above -= 1
        row = _row(path, lang, kind, name, None if kind == "import" else qualified, (line, place(max(end - 1, start))[0], column, place(max(end - 1, start))[1]), parent, None if kind == "import" else signature, None, annotations)
        rows.append(row)
        if kind not in ("import", "jsx_element", "type"):
            stack.append((end, row[0], name, kind))
    return rows


def parse_vue(path: str, text: str) -> list[tuple]:
    """Nodes of the script blocks, in place, after one for the component."""
    name = re.sub(r"\.vue$", "", path.rsplit("/", 1)[-1])
    rows = [_row(path, "vue", "class", name, name, (1, text.count("\n") + 1, 0, 0), None, None, None)]
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S):
        padded = re.sub(r"[^\n]", " ", text[: m.start(1)]) + m[1]
        for r in parse_by_pattern(path, "typescript", padded):
            rows.append((*r[:2], "vue", *r[3:10], r[10] or rows[0][0], *r[11:]))
    return rows


#: A language's parser: (path, text) to rows, registered under the language's name. Others may be added.
PARSERS = Registry()
PARSERS.add(10, "python", parse_python)
PARSERS.add(20, "vue", parse_vue)
for _n, _language in enumerate(PATTERNS):
    PARSERS.add(30 + _n, _language, partial(parse_by_pattern, lang=_language))


def parse(path: str, lang: str, text: str | None, parsers: dict | None = None) -> list[tuple]:
    """Rows of one file; a file that is too long or can't be parsed gives one row with an error."""
    if text is None or len(text) > MAX_CHARS:
        return [_row(path, lang, "error", "", None, (0, 0, 0, 0), error="empty" if text is None else "too long")]
    try:
        return (parsers or {n: build for n, build, _ in PARSERS})[lang](path, text=text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [_row(path, lang, "error", "", None, (0, 0, 0, 0), error=type(e).__name__)]


def nodes(files: DataFrame, parsers: Registry = PARSERS) -> DataFrame:
    """Node rows of files (path, language, content) of the languages that `parsers` has; their functions go to the executors."""
    by_language = {n: build for n, build, _ in parsers}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for path, lang, text in zip(part["path"], part["language"], part["content"]) for r in parse(path, lang, text, by_language)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    wanted = files.where(F.col("language").isin(*by_language))
    return wanted.select("path", "language", "content").mapInPandas(run, NODES)
