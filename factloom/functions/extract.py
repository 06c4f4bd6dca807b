"""Fact extraction from source text: Python by its syntax tree, JavaScript and TypeScript by a token scanner."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .facts import SCHEMA, Facts, failed_row
from .scripts import script_declarations

def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = _dotted(node.value)
        return f"{inner}.{node.attr}" if inner else None
    return None


class _PythonFacts(ast.NodeVisitor):
    """Facts of one declaration; nested declarations are not entered."""

    def __init__(self, facts: Facts):
        self.f = facts

    def visit_FunctionDef(self, node):  # noqa: N802
        pass

    visit_AsyncFunctionDef = visit_ClassDef = visit_FunctionDef  # noqa: N815

    def visit_Raise(self, node):  # noqa: N802
        self.f.throws += 1
        name = _dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc) if node.exc else None
        if name:
            self.f.throw_types.add(name)
        self.generic_visit(node)

    def visit_Return(self, node):  # noqa: N802
        self.f.returns += 1
        self.f.returns_nullish += isinstance(node.value, ast.Constant) and node.value.value is None
        self.generic_visit(node)

    def visit_Call(self, node):  # noqa: N802
        self.f.calls.add(ast.unparse(node.func))
        self.generic_visit(node)

    def visit_Constant(self, node):  # noqa: N802
        if isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and math.isfinite(node.value):
            self.f.numbers.add(float(node.value))

    def visit_Await(self, node):  # noqa: N802
        self.f.awaits += 1
        self.generic_visit(node)

    def visit_ExceptHandler(self, node):  # noqa: N802
        self.f.catches += 1
        self.f.empty_catches += len(node.body) == 1 and isinstance(node.body[0], ast.Pass)
        self.generic_visit(node)


def python_declarations(text: str) -> Iterator[Facts]:
    def walk(nodes, scope: tuple, in_class: bool):
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = node.args
                names = [x.arg for x in (*a.posonlyargs, *a.args)]
                extra = len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                own = len(names) - (in_class and bool(names) and names[0] in ("self", "cls"))
                facts = Facts(".".join((*scope, node.name)), "method" if in_class else "function", node.lineno, own + extra)
                for x in node.body:
                    _PythonFacts(facts).visit(x)
                yield facts
                yield from walk(node.body, (*scope, node.name), False)
            elif isinstance(node, ast.ClassDef):
                facts = Facts(".".join((*scope, node.name)), "class", node.lineno)
                for x in node.body:
                    _PythonFacts(facts).visit(x)
                yield facts
                yield from walk(node.body, (*scope, node.name), True)
            elif not isinstance(node, ast.expr):
                yield from walk([x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.ExceptHandler, ast.match_case))], scope, in_class)

    yield from walk(ast.parse(text).body, (), False)


#: Language workers by file extension.
WORKERS = {".py": python_declarations, ".js": script_declarations, ".ts": script_declarations, ".tsx": script_declarations}


def declarations_of(file: str, text: str) -> list[tuple]:
    """Rows of a file's declarations in source order; repeated identities get #2, #3; a syntax error gives one failed row."""
    worker = next((w for end, w in WORKERS.items() if file.lower().endswith(end)), None)
    if worker is None:
        raise ValueError(f"no language worker for {file}")
    try:
        found = list(worker(text))
    except (SyntaxError, ValueError, RecursionError):
        return [failed_row(file)]
    seen: dict[str, int] = {}
    rows = []
    for facts in sorted(found, key=lambda f: f.start):
        identity = f"{file}::{facts.identity}"
        seen[identity] = n = seen.get(identity, 0) + 1
        rows.append(facts.row(file, identity if n == 1 else f"{identity}#{n}"))
    return rows


def extract_declarations(files: DataFrame) -> DataFrame:
    """Declarations with facts of (path, content) rows; a file that cannot be parsed gives one row with ``failed``."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in declarations_of(p, c or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
