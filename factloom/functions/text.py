"""Scalar functions over identities, names and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(name: Column) -> Column:
    """Lower-case words of a camel, snake, dotted or dashed name: cut where a capital follows a small letter or digit, and at
    everything but ASCII letters and digits; a run of capitals stays one word."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda w: w != "")


def identity_file(identity: Column) -> Column:
    """What stands before the last ``::``."""
    return F.regexp_extract(identity, r"^(.*)::", 1)


def identity_name(identity: Column) -> Column:
    """What stands after the last ``::``, without the last ``:suffix``."""
    return F.regexp_replace(F.regexp_extract(identity, r"^(?:.*::)?(.*)$", 1), ":[^:]*$", "")


def relative_age(then: Column, now: Column) -> Column:
    """today, 1 day ago or N days ago by whole days of 24 hours; unknown without a date."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 86400)
    return F.when(then.isNull(), "unknown").when(days <= 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


# --- cleanup ---------------------------------------------------------------------------------------------------------


def escape_pattern(text: Column) -> Column:
    """``text`` as a regular expression that matches just it."""
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def escape_cell(value: Column) -> Column:
    """A table cell: bars escaped, lines joined, ``unknown`` for nothing."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("unknown")), r"\|", r"\\|"), "\n", " ")


def escape_markup(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def unquoted(text: Column) -> Column:
    """A literal without one quote on either side."""
    return F.regexp_replace(F.regexp_replace(text, "^[\"']", ""), "[\"']$", "")


def shown_list(values: Column) -> Column:
    """``[a, b]``, or a dash for nothing."""
    return F.when(values.isNull(), "-").otherwise(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))


# --- numbers and maps ------------------------------------------------------------------------------------------------


def snapped(value: Column, grid: int) -> Column:
    """The nearest multiple of ``grid``, halves up."""
    return (F.floor(value / grid + 0.5) * grid).cast("long")


def clamped(value: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def of_palette(palette: list[str], index: Column) -> Column:
    """The palette's colour at an index that may be past its end or below zero."""
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(index, F.lit(len(palette))) + 1).cast("int"))


def compact_delta(before: Column, after: Column) -> Column:
    """Map of the keys whose text values differ to (before, after); a key that one side lacks has null there."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.struct(F.try_element_at(before, k).alias("before"), F.try_element_at(after, k).alias("after")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: ~p["value"]["before"].eqNullSafe(p["value"]["after"])))


# --- JSON ------------------------------------------------------------------------------------------------------------


def model_json(text: Column) -> Column:
    """The JSON (text) in a model's answer: without code fences; if that is no JSON, from the first bracket to the last; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    plain = F.when(F.startswith(F.trim(text), F.lit("```")), bare).otherwise(F.trim(text))
    inner = F.regexp_extract(plain, r"(?s)([\[{].*[\]}])", 1)
    return F.coalesce(F.when(F.try_parse_json(plain).isNotNull(), plain), F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def signature(rows: Column) -> Column:
    """Digest of an array of structs, whatever its order."""
    return F.sha2(F.to_json(F.array_sort(rows)), 256)
