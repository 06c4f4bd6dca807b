"""Snapshot diff, significance of changes, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Properties whose change always matters, and prefixes of calls that never do.
ALWAYS_SIGNIFICANT = ("throws", "throw_types", "returns", "returns_nullish", "awaits", "catches", "empty_catches", "params")
NOISE_PREFIXES = ("console.", "logger.", "debug.")


def latest_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: the last by ``seq``, as a map keyed by identity keeps it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def diff_snapshots(before: DataFrame, after: DataFrame, properties: dict[str, Column], key: str = "identity", seq: str = "seq") -> DataFrame:
    """key, change_type and ``changes`` (property, before, after as text) by a null-safe full outer join.

    ``properties`` names comparable columns; each is evaluated on either side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return latest_by(df, key, seq).select(key, F.struct(*[v.alias(p) for p, v in properties.items()]).alias(name))

    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    text = lambda c: c.cast("string")
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), text(F.col(f"b.{p}")).alias("before"), text(F.col(f"a.{p}")).alias("after")) for p in properties])
    changes = F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))
    kind = F.when(F.col("a").isNull(), "deleted").when(F.col("b").isNull(), "added").when(F.size(changes) > 0, "changed").otherwise("unchanged")
    return both.select(key, kind.alias("change_type"), F.when(kind == "changed", changes).otherwise(F.slice(pairs, 1, 0)).alias("changes"))


def is_noise_call(call: Column, prefixes=NOISE_PREFIXES) -> Column:
    """Whether a call is a prefix or starts with one; an empty list of prefixes means the default one."""
    return F.coalesce(*[F.when(call.startswith(p), True) for p in prefixes or NOISE_PREFIXES], F.lit(False))


def calls_only_noise(before: Column, after: Column, prefixes=NOISE_PREFIXES) -> Column:
    """Whether the symmetric difference of two call arrays is noise throughout (true when only the order differs)."""
    return F.forall(F.concat(F.array_except(before, after), F.array_except(after, before)), lambda c: is_noise_call(c, prefixes))


def is_property_significant(prop: Column, before: Column, after: Column) -> Column:
    """Significance of one changed property; ``calls`` compares comma-joined lists."""
    calls = ~calls_only_noise(F.filter(F.split(before, ","), lambda c: c != ""), F.filter(F.split(after, ","), lambda c: c != ""))
    return F.when(prop.isin(*ALWAYS_SIGNIFICANT), True).when(prop == "numbers", True).when(prop == "calls", calls).otherwise(False)


def property_changes(diff: DataFrame, key: str = "identity") -> DataFrame:
    """One row a changed property with its significance."""
    rows = diff.where("change_type = 'changed'").select(key, "change_type", F.explode("changes").alias("c")).select(key, "change_type", "c.*")
    return rows.withColumn("significant", is_property_significant(F.col("property"), F.col("before"), F.col("after")))


def analyse_significance(diff: DataFrame, key: str = "identity") -> DataFrame:
    """key, declaration_type, n_reasons of what makes a session significant: added, deleted, and significantly changed."""
    whole = diff.where(F.col("change_type").isin("added", "deleted")).select(key, F.col("change_type").alias("declaration_type"), F.lit(0).cast("long").alias("n_reasons"))
    part = property_changes(diff, key).where("significant").groupBy(key).agg(F.count("*").alias("n_reasons"))
    return whole.unionByName(part.select(key, F.lit("changed").alias("declaration_type"), "n_reasons"))


def suffix_repeated(df: DataFrame, scope: list[str], key: str, order: str) -> DataFrame:
    """Identities made unique in their scope: the second gets #2, the third #3, in ``order``."""
    n = F.row_number().over(Window.partitionBy(*scope, key).orderBy(order))
    return df.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("#"), n.cast("string"))).otherwise(F.col(key)))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def baseline_projection(df: DataFrame) -> DataFrame:
    """The persisted columns of a snapshot: positions and names are dropped."""
    return df.select("identity", "file", "kind", "facts")
