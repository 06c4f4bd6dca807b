"""Import and re-export records of source text: JavaScript and TypeScript by tokens, Python by its syntax tree."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .scripts import script_tokens

#: ``what`` is import, reexport (``local`` is the name it gives, ``imported`` the source's) or default (``local`` is the name).
SCHEMA = "importer string, pos int, what string, source string, dots int, imported string, local string, kind string, failed boolean"
_DEFAULTS = (re.compile(r"export\s+default\s+(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)"), re.compile(r"export\s+default\s+([A-Za-z_$][\w$.]*)\s*;"))


def _unquoted(token: tuple) -> str | None:
    return token[1][1:-1] if token[0] == "string" and token[1][0] != "`" else None


def _braced(tokens: list, at: int) -> tuple[list[tuple[str, str, str]], int]:
    """(first name, joiner, second name) of the comma-separated parts of the braces that open at ``at``, and what follows them."""
    parts, now, depth, k = [], [], 0, at + 1
    while k < len(tokens):
        kind, t, _ = tokens[k]
        if depth == 0 and t in ("}", ","):
            if now:
                parts.append(now)
            now = []
            if t == "}":
                break
        else:
            depth += (t in ("{", "(", "[")) - (t in ("}", ")", "]"))
            now.append((kind, t))
        k += 1
    out = []
    for part in parts:
        if part[0][1] == "type" and len(part) > 1 and part[1][1] != "as":
            part = part[1:]
        names = [t for kind, t in part if kind in ("name", "string")]
        joiner = ":" if any(t == ":" for _, t in part[1:2]) else "=" if any(t == "=" for _, t in part) else "as" if len(names) > 1 else ""
        rest = "".join(t for _, t in part[2:]) if joiner == ":" else names[-1] if names else ""
        out.append((names[0] if names else part[0][1], joiner, rest))
    return out, k + 1


def script_imports(text: str) -> Iterator[tuple]:
    """(what, source, dots, imported, local, kind) in source order."""
    tokens = script_tokens(text)
    at = lambda i: tokens[i][1] if 0 <= i < len(tokens) else ""
    for i, (kind, t, _) in enumerate(tokens):
        if kind != "name" or at(i - 1) == ".":
            continue
        if t == "import" and at(i + 1) not in ("(", "."):
            k, found = i + 1, []
            k += at(k) == "type" and at(k + 1) not in ("from", ",", "=")
            if k < len(tokens) and tokens[k][0] == "name":
                found.append(("default", at(k), "default"))
                k += 1 + (at(k + 1) == ",")
            if at(k) == "*" and at(k + 1) == "as":
                found.append(("*", at(k + 2), "namespace"))
                k += 3
            elif at(k) == "{":
                named, k = _braced(tokens, k)
                found += [(a, b or a, "named") for a, _, b in named]
            if at(k) == "from" and k + 1 < len(tokens) and (source := _unquoted(tokens[k + 1])) is not None:
                for imported, local, how in found:
                    yield "import", source, 0, imported, local, how
        elif t == "export" and at(i + 1) == "{":
            named, k = _braced(tokens, i + 1)
            if at(k) == "from" and k + 1 < len(tokens) and (source := _unquoted(tokens[k + 1])) is not None:
                for a, _, b in named:
                    yield "reexport", source, 0, a, b or a, "reexport"
        elif t == "require" and at(i + 1) == "(" and at(i - 1) == "=" and at(i + 3) == ")" and at(i + 4) not in (".", "(", "[") and (source := _unquoted(tokens[i + 2])):
            if tokens[i - 2][0] == "name" and at(i - 3) in ("const", "let", "var", ","):
                yield "import", source, 0, "*", at(i - 2), "commonjs"
            elif at(i - 2) == "}":
                depth, k = 1, i - 3
                while k >= 0 and depth:
                    depth += (at(k) == "}") - (at(k) == "{")
                    k -= 1
                if at(k) in ("const", "let", "var", ","):
                    for a, joiner, b in _braced(tokens, k + 1)[0]:
                        if joiner != "=":
                            yield "import", source, 0, a, b or a, "commonjs-named"
    for name in dict.fromkeys(m[1] for pattern in _DEFAULTS for m in pattern.finditer(text)):
        yield "default", None, 0, None, name, "default"


def python_imports(text: str) -> Iterator[tuple]:
    nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.Import, ast.ImportFrom))]
    for node in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
        for alias in node.names:
            if isinstance(node, ast.Import):
                yield "import", alias.name, 0, None, alias.asname or alias.name, "module"
            elif node.module != "__future__" or node.level:
                yield "import", node.module, node.level, alias.name, alias.asname or alias.name, "wildcard" if alias.name == "*" else "named"


def imports_of(file: str, text: str) -> list[tuple]:
    """Rows of a file's records in source order; a syntax error gives one failed row."""
    worker = python_imports if file.lower().endswith(".py") else script_imports
    try:
        return [(file, i, *row, False) for i, row in enumerate(worker(text))]
    except (SyntaxError, ValueError, RecursionError):
        return [(file, None, None, None, None, None, None, None, True)]


def extract_imports(files: DataFrame) -> DataFrame:
    """Import, re-export and default-export records of (path, content) rows; a file that cannot be parsed gives a failed row."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in imports_of(p, c or "")], columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
