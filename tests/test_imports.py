"""Import records and their resolution on hand-written sources."""

from pyspark.sql import functions as F

from factloom.functions import imports as records
from factloom.operators import graph, imports


def of(text, file="a.ts"):
    return [r[2:8] for r in records.imports_of(file, text)]


def test_script_records():
    assert of('import x from "./a"') == [("import", "./a", 0, "default", "x", "default")]
    assert of("import {a, b as c, type D} from './a.js';") == [("import", "./a.js", 0, "a", "a", "named"), ("import", "./a.js", 0, "b", "c", "named"), ("import", "./a.js", 0, "D", "D", "named")]
    assert of('import x, * as y from "z"; import type {T} from "./t"') == [("import", "z", 0, "default", "x", "default"), ("import", "z", 0, "*", "y", "namespace"), ("import", "./t", 0, "T", "T", "named")]
    assert of('import "./effect"; const z = import("./late");') == []
    assert of('const a = require("./a"), {b, c: d, e = 1} = require("./b");') == [("import", "./a", 0, "*", "a", "commonjs"), ("import", "./b", 0, "b", "b", "commonjs-named"), ("import", "./b", 0, "c", "d", "commonjs-named")]
    assert of('a = require("./a"); const f = require("./b").f; const g = my.require("./c"); // import q from "./q"') == []
    assert of('export {a as b} from "./x"; export {c}; export default async function go() {}\nexport default bound ;') == [("reexport", "./x", 0, "a", "b", "reexport"), ("default", None, 0, None, "go", "default"), ("default", None, 0, None, "bound", "default")]


def test_python_records():
    text = "import a.b as c, d\nfrom __future__ import annotations\ndef f():\n    from ..x import y as z, w\nfrom . import *\n"
    assert of(text, "m.py") == [("import", "a.b", 0, None, "c", "module"), ("import", "d", 0, None, "d", "module"), ("import", "x", 2, "y", "z", "named"), ("import", "x", 2, "w", "w", "named"), ("import", None, 1, "*", "*", "wildcard")]
    assert records.imports_of("bad.py", "def (")[0][-1] is True


def test_module_candidates(spark):
    row = spark.range(1).select(imports.module_candidates(F.lit("a/b.js")).alias("x"), imports.joined_path(F.lit("a/b"), F.lit("../../c/./d")).alias("y"), imports.joined_path(F.lit("a"), F.lit("../../x")).alias("z"), imports.module_candidates(F.lit("user.service")).alias("w")).first()
    assert row["x"] == ["a/b.js", "a/b.jsx", "a/b.ts", "a/b.tsx", "a/b.js/index.js", "a/b.js/index.jsx", "a/b.js/index.ts", "a/b.js/index.tsx"] and row["y"] == "c/d" and row["z"] is None
    assert "user.ts" in row["w"] and "user.service.ts" not in row["w"]


def test_same_names_stay_apart(spark):
    texts = {"a.ts": 'import {run} from "./b"; import {twice} from "./b"; import {gone} from "./c"', "b.ts": "", "c.ts": 'export {gone} from "./d"'}
    rows = spark.createDataFrame([r for f, t in texts.items() for r in records.imports_of(f, t)], records.SCHEMA)
    files = spark.createDataFrame([(f, False) for f in texts], "path string, failed boolean")
    declared = spark.createDataFrame([("b.ts::run:function", "b.ts", "run"), ("c.ts::run:function", "c.ts", "run"), ("b.ts::twice:function", "b.ts", "twice"), ("b.ts::twice:function#2", "b.ts", "twice")], "identity string, file string, name string")
    got = {r["imported"]: (r["to"], r["reason"]) for r in imports.resolve_imports(rows, files, declared).collect()}
    assert got["run"] == ("b.ts::run:function", "relative-module-resolved") and got["twice"] == (None, "target-declaration-not-found") and got["gone"] == (None, "target-declaration-not-found")


def test_depth_first_callers(spark):
    index = spark.createDataFrame([("a", "f::b:function", "x"), ("b", "f::c:function", "x"), ("c", "f::d:function", "x"), ("a", "f::d:function", "x"), ("d", "f::a:function", "x"), ("d", "f::e:getter", "x")], "callee string, caller string, confidence string")
    got = lambda n: [(r["identity"], r["depth"]) for r in graph.find_callers(index, "a", n).orderBy("place").collect()]
    assert got(1) == [("f::b:function", 1), ("f::d:function", 1)]
    # d is met at depth 3 first, by way of b and c, though it calls a itself.
    assert got(3) == [("f::b:function", 1), ("f::c:function", 2), ("f::d:function", 3)]
    assert got(5) == [("f::b:function", 1), ("f::c:function", 2), ("f::d:function", 3), ("f::a:function", 4), ("f::e:getter", 4)]
    assert graph.find_callers(index, "", 3).count() == 0 and graph.find_callers(index, "nobody", 3).count() == 0
