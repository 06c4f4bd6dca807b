"""Validation of plan documents whose parts may be of any JSON type, as expressions over VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a plan document may say.
LENS_SOURCES = ("derived", "human_added")
ORIGINS = ("ai_drafted", "human_authored", "ai_edited_by_human")
STATUSES = ("intended", "approved", "implemented", "drifted", "error", "superseded")
ROLES = ("behaviour", "vocabulary", "machinery", "tool")
RULE_KINDS = ("behaviour", "structure")
MERGES = ("family", "summary")
ASSERT_OPERATORS = (">=", "<=", "==", "!=", "contains", "notContains", "unchanged")
FACT_FIELDS = ("throws", "throwTypes", "returns", "returnsNullish", "calls", "numbers", "awaits", "catches", "emptyCatches", "params", "entryCount", "entries")
STRUCTURE_FIELDS = ("mustNotImport", "mustImport")


class Value:
    """A JSON value that may be missing."""

    def __init__(self, column: Column, kind: Column | None = None):
        self.column = column
        self.kind = F.schema_of_variant(column) if kind is None else kind

    def get(self, name: str) -> Value:
        return Value(F.when(self.is_object, F.try_variant_get(self.column, f"$['{name}']", "variant")))

    @property
    def given(self) -> Column:
        return self.column.isNotNull()

    @property
    def is_string(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    @property
    def is_object(self) -> Column:
        return F.coalesce(self.kind.startswith("OBJECT"), F.lit(False))

    @property
    def is_array(self) -> Column:
        return F.coalesce(self.kind.startswith("ARRAY"), F.lit(False))

    @property
    def items(self) -> Column:
        return F.coalesce(F.when(self.is_array, F.try_variant_get(self.column, "$", "array<variant>")), F.array().cast("array<variant>"))

    @property
    def entries(self) -> Column:
        """key and value of an object's members, by key."""
        return F.coalesce(F.when(self.is_object, F.array_sort(F.map_keys(F.try_variant_get(self.column, "$", "map<string,variant>")))), F.array().cast("array<string>"))

    def member(self, name: Column) -> Value:
        return Value(F.when(self.is_object, F.element_at(F.try_variant_get(self.column, "$", "map<string,variant>"), name)))

    @property
    def text(self) -> Column:
        return F.when(self.is_string, F.try_variant_get(self.column, "$", "string"))

    @property
    def is_strings(self) -> Column:
        return self.is_array & F.forall(self.items, lambda x: Value(x).is_string)

    @property
    def is_positive_whole(self) -> Column:
        number = F.when(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(self.column, "$", "double"))
        return F.coalesce((number >= 1) & (number == F.floor(number)), F.lit(False))

    def among(self, allowed: tuple[str, ...]) -> Column:
        return F.coalesce(self.text.isin(*allowed), F.lit(False))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _held(values: dict[str, Value], body: Callable[[dict[str, Value]], Column]) -> Column:
    """``body`` of the values, each of which is computed once with its kind; what is read from a value would compute it again."""
    given = F.struct(*[v.column.alias(f"v{i}") for i, v in enumerate(values.values())])
    with_kinds = lambda x: F.struct(*[c for i in range(len(values)) for c in (x[f"v{i}"].alias(f"v{i}"), F.schema_of_variant(x[f"v{i}"]).alias(f"k{i}"))])
    of = lambda y: body({name: Value(y[f"v{i}"], y[f"k{i}"]) for i, name in enumerate(values)})
    return _once(given, lambda x: _once(with_kinds(x), of))


def _fields(value: Value, names: list[str], body: Callable[[Callable[[str], Value]], Column]) -> Column:
    """``body(g)`` with ``g(name)`` for the members of an object."""
    return _held({n: value.get(n) for n in names}, lambda held: body(held.__getitem__))


def _said(prefix: Column, what: str) -> Column:
    return F.concat(prefix, F.lit(what))


def _one(problem: Column, message: Column) -> Column:
    return F.when(problem, F.array(message)).otherwise(F.array().cast("array<string>"))


def _text(value: Value, where: Column) -> Column:
    return _one(~F.coalesce(F.trim(F.regexp_replace(value.text, r"\s", " ")) != "", F.lit(False)), _said(where, " must be a non-empty string"))


def _optional(value: Value, holds: Callable[[Value], Column], where: Column, what: str) -> Column:
    return _one(value.given & ~holds(value), _said(where, what))


def _all(*lists: Column) -> Column:
    return F.concat(*lists)


def _object_or(value: Value, where: Column, body: Column) -> Column:
    return F.when(value.is_object, body).otherwise(F.array(_said(where, " must be an object")))


def _object_with(value: Value, where: Column, names: list[str], body: Callable[[Callable[[str], Value]], Column]) -> Column:
    """The problems that ``body(g)`` finds in an object's members ``g(name)``, or that it is none."""
    return _held({"": value}, lambda held: _object_or(held[""], where, _fields(held[""], names, body)))


def _each(value: Value, check: Callable[[Value, Column], Column], where: Column) -> Column:
    """The problems of an array's members in their order."""
    return F.flatten(F.transform(value.items, lambda x, i: check(Value(x), F.concat(where, F.lit("["), i.cast("string"), F.lit("]")))))


def identities_of(node: Value) -> Column:
    """A node's declarations: its list if it has any, else its one identity."""
    return _own_identities(node.get("identities"), node.get("identity"))


def _own_identities(listed: Value, one: Value) -> Column:
    many = F.filter(F.transform(listed.items, lambda x: Value(x).text), lambda x: x.isNotNull())
    return _once(many, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array_compact(F.array(F.nullif(one.text, F.lit(""))))))


def lens_problems(lens: Value, where: Column) -> Column:
    body = lambda g: _all(
        _text(g("id"), _said(where, ".id")), _text(g("label"), _said(where, ".label")),
        _optional(g("source"), lambda x: x.among(LENS_SOURCES), where, ".source must be derived or human_added"),
        *[_optional(g(k), lambda x: x.is_string, where, f".{k} must be a string") for k in ("derivedFrom", "color")],
    )
    return _object_with(lens, where, ["id", "label", "source", "derivedFrom", "color"], body)


def feature_problems(feature: Value, where: Column) -> Column:
    body = lambda g: _all(
        _text(g("id"), _said(where, ".id")), _text(g("name"), _said(where, ".name")),
        _optional(g("status"), lambda x: x.among(STATUSES), where, ".status is invalid"),
        _optional(g("source"), lambda x: x.among(LENS_SOURCES), where, ".source must be derived or human_added"),
        *[_optional(g(k), lambda x: x.is_string, where, f".{k} must be a string") for k in ("derivedFrom", "color")],
    )
    return _object_with(feature, where, ["id", "name", "status", "source", "derivedFrom", "color"], body)


def _clause_problems(clause: Value, where: Column) -> Column:
    body = lambda g: _all(
        _one(~g("op").among(ASSERT_OPERATORS), _said(where, ".op is not supported")),
        _one(~g("value").given & ~F.coalesce(g("op").text == "unchanged", F.lit(False)), _said(where, ".value is required")),
    )
    return _object_with(clause, where, ["op", "value"], body)


def rule_problems(rule: Value, where: Column) -> Column:
    def body(g: Callable[[str], Value]) -> Column:
        asserted = g("assert")
        structure = F.coalesce(g("kind").text == "structure", F.lit(False))

        def of(field: Column) -> Column:
            clause, at = asserted.member(field), F.concat(where, F.lit(".assert."), field)
            on_structure = lambda held: _all(
                _one(~field.isin(*STRUCTURE_FIELDS), _said(at, " is not a supported structure assertion")),
                _one(~held["clause"].is_string & ~held["clause"].is_array, _said(at, " must be a string or array")),
            )
            on_facts = F.when(field.isin(*FACT_FIELDS), _clause_problems(clause, at)).otherwise(F.array(_said(at, " is not a supported fact field")))
            return F.when(structure, _held({"clause": clause}, on_structure)).otherwise(on_facts)

        return _all(
            _one(~g("kind").among(RULE_KINDS), _said(where, ".kind must be behaviour or structure")),
            _text(g("target"), _said(where, ".target")),
            F.when(~asserted.given, F.array().cast("array<string>")).otherwise(_object_or(asserted, _said(where, ".assert"), F.flatten(F.transform(asserted.entries, of)))),
        )

    return _object_with(rule, where, ["kind", "target", "assert"], body)


_NODE_FIELDS = (
    "id title intent version supersedes feature identity identities merge summaryOf dimensions role step path lensTags edgesOut rules status origin approvedBy approvedAt approvedFacts"
    " approvedFactsByIdentity annotation createdAt"
).split()


def node_problems(node: Value, where: Column) -> Column:
    return _object_with(node, where, _NODE_FIELDS, lambda g: _once(_own_identities(g("identities"), g("identity")), lambda held: _node_problems(g, held, where)))


def _node_problems(g: Callable[[str], Value], held: Column, where: Column) -> Column:
    strings = lambda name: _optional(g(name), lambda x: x.is_strings, where, f".{name} must be an array of strings")
    string = lambda name: _optional(g(name), lambda x: x.is_string, where, f".{name} must be a string")
    strange = lambda found, at, what: F.transform(F.filter(found, lambda x: ~F.array_contains(held, x)), lambda x: F.concat(at, F.lit(what), x, F.lit(", which the node does not stand for")))
    first = F.get(F.transform(g("identities").items, lambda x: Value(x).text), F.lit(0))

    def covered(entry: Value, at: Column) -> Column:
        def body(of: Callable[[str], Value]) -> Column:
            named = of("identities")
            own = F.transform(named.items, lambda x: Value(x).text)
            which = F.when(named.is_strings, strange(own, at, ".identities includes ")).otherwise(F.array(_said(at, ".identities must be an array of strings")))
            return _all(which, _text(of("title"), _said(at, ".title")))

        return _object_with(entry, at, ["identities", "title"], body)

    by_identity = g("approvedFactsByIdentity")

    def snapshots(field: Column) -> Column:
        at = _said(where, ".approvedFactsByIdentity")
        return _all(strange(F.array(field), at, " has "), _one(~by_identity.member(field).is_object, F.concat(at, F.lit("."), field, F.lit(" must be an object"))))

    def listed(name: str, check: Callable[[Value, Column], Column]) -> Column:
        some = F.when(g(name).is_array, _each(g(name), check, _said(where, f".{name}"))).otherwise(F.array(_said(where, f".{name} must be an array")))
        return F.when(g(name).given, some).otherwise(F.array().cast("array<string>"))

    return _all(
        *[_text(g(k), _said(where, f".{k}")) for k in ("id", "title", "intent")],
        _optional(g("version"), lambda x: x.is_positive_whole, where, ".version must be a positive integer"),
        *map(string, ("supersedes", "feature", "identity")),
        strings("identities"),
        _one(g("identities").is_strings & (F.size(g("identities").items) > 0) & ~first.eqNullSafe(g("identity").text), _said(where, ".identities[0] must be the node's own identity")),
        _optional(g("merge"), lambda x: x.among(MERGES), where, ".merge must be family or summary"),
        _one(g("merge").given & (F.size(g("identities").items) < 2), _said(where, ".merge requires more than one identity")),
        listed("summaryOf", covered),
        strings("dimensions"),
        _optional(g("role"), lambda x: x.among(ROLES), where, ".role is invalid"),
        _optional(g("step"), lambda x: x.is_positive_whole, where, ".step must be a positive integer"),
        *map(strings, ("path", "lensTags", "edgesOut")),
        listed("rules", rule_problems),
        _optional(g("status"), lambda x: x.among(STATUSES), where, ".status is invalid"),
        _optional(g("origin"), lambda x: x.among(ORIGINS), where, ".origin is invalid"),
        *map(string, ("approvedBy", "approvedAt")),
        _optional(g("approvedFacts"), lambda x: x.is_object, where, ".approvedFacts must be an object"),
        F.when(~by_identity.given, F.array().cast("array<string>")).otherwise(_object_or(by_identity, _said(where, ".approvedFactsByIdentity"), F.flatten(F.transform(by_identity.entries, snapshots)))),
        *map(string, ("annotation", "createdAt")),
    )


def plan_problems(document: Column) -> Column:
    """The ordered problems of a whole plan document (JSON text); an empty list if it is valid."""
    return _held({"": Value(F.try_parse_json(document))}, lambda held: _plan_problems(held[""]))


def _plan_problems(plan: Value) -> Column:
    version = F.try_variant_get(plan.column, "$.version", "double")
    lists = {"lenses": lens_problems, "features": feature_problems, "nodes": node_problems}
    body = _all(
        _one(~F.coalesce(version == 1, F.lit(False)) | plan.get("version").is_string, F.lit("version must be 1")),
        *[_one(~plan.get(k).is_array, F.lit(f"{k} must be an array")) for k in lists],
        *[_each(plan.get(k), check, F.lit(k)) for k, check in lists.items()],
    )
    return F.when(plan.is_object, body).otherwise(F.array(F.lit("plan must be an object")))


def node_row_problems(rows: DataFrame, document: str, index: str) -> DataFrame:
    """index, place, error of plan nodes that come as rows of JSON text, each named by its index."""
    where = F.concat(F.lit("nodes["), F.col(index).cast("string"), F.lit("]"))
    problems = node_problems(Value(F.try_parse_json(document)), where)
    return rows.select(index, F.posexplode(problems).alias("place", "error"))
