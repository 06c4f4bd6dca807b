"""Declarations of scripts: names, kinds, scopes, lists and facts."""

from factloom.functions import extract, scripts
from factloom.operators import graph


def of(text, file="a.ts"):
    rows = extract.declarations_of(file, text)
    return {r[1].split("::")[1]: dict(zip([c.split(" ")[0] for c in extract.SCHEMA.split(", ")], r, strict=True)) for r in rows}


def test_same_names_stay_apart():
    found = of("""
function run() { function run() { return 1; } return run(); }
const api = { run() { return 2; }, run2: function () {}, 'quoted key': () => 3, inner: { deep(a) { return a; } } };
class Box { run() {} static run() {} get size() { return this.n; } set size(v) { this.n = v; } static make = () => new Box(); handler = async (e) => { await save(e); }; #hidden() {} ['computed']() {} }
function run() {}
""")
    assert {k: v["kind"] for k, v in found.items()} == {
        "run:function": "function", "run.run:function": "function", "run:function#2": "function", "api:data": "data", "api.run:method": "method", "api.run2:function": "function", "api.quoted key:function": "function",
        "api.inner.deep:method": "method", "Box:class": "class", "Box.run:method": "method", "Box.run:method:static": "method", "Box.size:getter": "getter", "Box.size:setter": "setter", "Box.make:function:static": "function",
        "Box.handler:function": "function", "Box.#hidden:method": "method",
    }
    assert found["Box.handler:function"]["awaits"] == 1 and found["Box.handler:function"]["calls"] == ["save"] and found["Box.size:setter"]["params"] == 1
    assert found["run:function"]["calls"] == ["run"] and found["run:function"]["returns"] == 1 and found["run.run:function"]["numbers"] == [1.0]


def test_scopes():
    found = of("""
describe("orders", () => { const total = (a, b) => a + b; it('adds', function () { function helper() {} }); });
namespace Shop.Cart { export function add(x: number): number { return x; } }
module.exports.load = async function (id) { return null; };
settings = { on() {} };
const Made = class Named { go() {} };
export default function main<T>(a: Map<string, T>, { b, c } = {}, ...rest): Promise<{ d: T }> { return go<T>(a); }
abstract class Base { abstract draw(): void; protected async paint(ctx?: Ctx): Promise<void> { ctx?.fill(1_000, 0x10, 2.5e3, 10n); } }
let first = 1, pick = x => x * 2, obj: Cfg = { k: 1 }
""")
    assert set(found) == {
        "orders.total:function", "orders.adds.helper:function", "Shop.Cart.add:function", "module.exports.load:function", "settings.on:method", "Made:class", "Made.go:method", "main:function", "Base:class", "Base.paint:method",
        "pick:function", "obj:data",
    }
    assert found["main:function"]["params"] == 3 and found["main:function"]["calls"] == ["go"] and found["module.exports.load:function"]["returns_nullish"] == 1
    assert found["Base.paint:method"]["numbers"] == [16.0, 2500.0] and found["Base.paint:method"]["calls"] == ["ctx.fill"] and found["Base.paint:method"]["modifiers"] == ["async"]


def test_lists_and_callbacks():
    found = of("""
export const ROUTES = ['home', "about", /* no */ `x`, path.join(a, b), { deep: [1, 2] }];
const TABLE = { "a-b": 1, c: [2], d() {}, e, f: handler };
function inside() { const LOCAL = [1, 2]; google.init({ callback: onLogin, size: 3, other: { again: onLogout }, fn: () => 1, off: null }); return cond ? a : b; }
""")
    assert (found["ROUTES:data"]["shape"], found["ROUTES:data"]["entry_count"], found["ROUTES:data"]["entries"]) == ("array", 5, ["home", "about", "x", "path.join(a, b)", "{ deep: [1, 2] }"])
    assert (found["TABLE:data"]["shape"], found["TABLE:data"]["entries"], found["TABLE:data"]["callbacks"]) == ("object", ["a-b", "c", "f"], ["handler"])
    assert "LOCAL:data" not in found and found["inside:function"]["callbacks"] == ["onLogin", "onLogout"] and found["inside:function"]["calls"] == ["google.init"]
    many = of("const MANY = [" + ", ".join(map(str, range(80))) + "];")["MANY:data"]
    assert many["entry_count"] == 80 and len(many["entries"]) == 60 and len(many["numbers"]) == 80


def test_regular_expressions_and_comments():
    found = of("function f(s) { const r = /[{(\"']+/g; if (/\\//.test(s)) { return s.replace(/}/, '') } /* { */ return a / b / c; } // {")
    assert set(found) == {"f:function"} and found["f:function"]["returns"] == 2 and found["f:function"]["calls"] == ["s.replace"]
    nested = "a(`x ${b.map(c => `<i>${c ? `{` : '`'}</i>`).join('}')} y`, 2)"
    assert [t[1] for t in scripts.script_tokens(nested)] == ["a", "(", nested[2:-4], ",", "2", ")"]
    assert [t[0] for t in scripts.script_tokens("x = /a/ / 2")] == ["name", "op", "regex", "op", "number"]
    assert extract.declarations_of("a.js", "function f( {")[0][-1] is True


def test_calls_through_this_have_no_name():
    assert of("class A { go() { this.db.put(1); super.go(); make().run(); list[0].x(); B.c.d(); new E(); } }")["A.go:method"]["calls"] == ["B.c.d", "make"]


def test_callbacks_make_call_edges(spark):
    texts = spark.createDataFrame([("a.ts", "function onLogin() {}\nfunction start() { init({callback: onLogin}); }"), ("b.ts", "export function init(o) {}")], "path string, content string")
    edges = graph.resolve_calls(extract.extract_declarations(texts)).collect()
    assert {tuple(e) for e in edges} == {("a.ts::start:function", "b.ts::init:function"), ("a.ts::start:function", "a.ts::onLogin:function")}
