"""The clause language: static checks, evaluation against facts, and verification of approved nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields by type, and operators.
NUMERIC_FIELDS = ("throws", "returns", "returns_nullish", "awaits", "catches", "empty_catches", "params", "entry_count")
LIST_FIELDS = ("throw_types", "calls", "numbers", "entries")
NUMERIC_OPERATORS = (">=", "<=", "==", "!=")
LIST_OPERATORS = ("contains", "notContains")


def clause_problem(field: Column, op: Column) -> Column:
    """Why a clause can never be evaluated, or null."""
    return (
        F.when(~field.isin(*NUMERIC_FIELDS, *LIST_FIELDS), "unknown field")
        .when(~op.isin(*NUMERIC_OPERATORS, *LIST_OPERATORS, "unchanged"), "unknown operator")
        .when(field.isin(*LIST_FIELDS) & op.isin(*NUMERIC_OPERATORS), "needs a number")
        .when(field.isin(*NUMERIC_FIELDS) & op.isin(*LIST_OPERATORS), "needs a list")
    )


def _number(row: str, fields: list[str], field: Column) -> Column:
    return F.coalesce(*[F.when(field == f, F.col(f"{row}.{f}").cast("double")) for f in fields], F.lit(None).cast("double"))


def _list(row: str, fields: list[str], field: Column) -> Column:
    return F.coalesce(*[F.when(field == f, F.col(f"{row}.{f}").cast("array<string>")) for f in fields], F.lit(None).cast("array<string>"))


def evaluate(rows: DataFrame, facts: str = "facts", approved: str = "approved") -> DataFrame:
    """``rows`` (structs of facts and approved facts, a struct ``clause`` of field, op, value_num, value_str) with error and pass.

    Errors in order: field absent, unchanged without a snapshot, bad clause, value of the wrong type. ``pass`` is null on error.
    """
    names = rows.schema[facts].dataType.names
    numbers, lists = [f for f in names if f in NUMERIC_FIELDS], [f for f in names if f in LIST_FIELDS]
    field, op = F.col("clause.field"), F.col("clause.op")
    n, a = _number(facts, numbers, field), _list(facts, lists, field)
    n0, a0 = _number(approved, numbers, field), _list(approved, lists, field)
    num, text = F.col("clause.value_num"), F.col("clause.value_str")
    # ``numbers`` holds numbers, so its members are compared as such; the other lists hold text.
    of_numbers = field == "numbers"
    digits = F.col(f"{facts}.numbers").cast("array<double>") if "numbers" in names else F.lit(None).cast("array<double>")
    held = F.when(of_numbers, F.array_contains(digits, num)).otherwise(F.array_contains(a, text))
    error = (
        F.when(n.isNull() & a.isNull(), "field absent")
        .when((op == "unchanged") & F.col(approved).isNull(), "no snapshot")
        .when(clause_problem(field, op).isNotNull(), clause_problem(field, op))
        .when((op.isin(*NUMERIC_OPERATORS) | op.isin(*LIST_OPERATORS) & of_numbers) & num.isNull() | op.isin(*LIST_OPERATORS) & ~of_numbers & text.isNull(), "type mismatch")
    )
    holds = (
        F.when(op == ">=", n >= num).when(op == "<=", n <= num).when(op == "==", n == num).when(op == "!=", n != num)
        .when(op == "contains", held).when(op == "notContains", ~held)
        .when(op == "unchanged", n.eqNullSafe(n0) & a.eqNullSafe(a0))
    )
    return rows.withColumn("error", error).withColumn("pass", F.when(F.col("error").isNull(), holds))


def verify(evaluated: DataFrame, node: str) -> DataFrame:
    """node, status (error, drifted, implemented), n_violations, n_errors."""
    out = evaluated.groupBy(node).agg(F.count_if(~F.col("pass")).alias("n_violations"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    status = F.when(F.col("n_errors") > 0, "error").when(F.col("n_violations") > 0, "drifted").otherwise("implemented")
    return out.select(node, status.alias("status"), "n_violations", "n_errors")


def assert_holds(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, holds: every clause of the group passes and there is one; an error does not pass."""
    return evaluated.groupBy(*keys).agg(F.bool_and(F.coalesce("pass", F.lit(False))).alias("holds"))


def merge_gate(held: DataFrame, group: str, rule: str) -> DataFrame:
    """group, mergeable: some rule holds for all members (relational division)."""
    per_rule = held.groupBy(group, rule).agg(F.bool_and("holds").alias("all_hold"))
    return per_rule.groupBy(group).agg(F.bool_or("all_hold").alias("mergeable"))


def select_nodes(nodes: DataFrame, identity: str | None = None, lens: str | None = None, feature: str | None = None, every: bool = False) -> DataFrame:
    """Nodes by exactly one of identity, every, lens or feature; lens and feature may be combined."""
    if sum(x is not None for x in (identity, lens or feature)) + every != 1:
        raise ValueError("give exactly one selector")
    out = nodes
    if identity is not None:
        out = out.where((F.col("identity") == identity) | F.array_contains("identities", identity))
    if lens is not None:
        out = out.where(F.array_contains("lens_tags", lens))
    if feature is not None:
        out = out.where(F.col("feature") == feature)
    return out


def capture_approval(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """id, n_identities, error: approval needs every identity of a node in the current facts."""
    each = nodes.select("id", F.explode("identities").alias("identity")).join(current.select("identity", F.lit(True).alias("found")), "identity", "left")
    return each.groupBy("id").agg(F.count("*").alias("n_identities"), (~F.bool_and(F.coalesce("found", F.lit(False)))).alias("error"))


def rule_targets(nodes: DataFrame, rules: DataFrame, current: DataFrame) -> DataFrame:
    """One row a rule (id, place): target, problem, unsupported, facts and approved facts of just that target.

    ``nodes`` has id, identity, identities, approved, approved_by_identity (map); ``rules`` id, place, kind, target; ``current``
    identity and facts. A target that the node does not stand for, or that the project lacks, is a problem; a rule without
    one means the node's own identity. Structure rules are unsupported and never fail; rules of other kinds are left out.
    """
    own = F.when(F.size(F.coalesce("identities", F.array().cast("array<string>"))) > 0, F.col("identities")).otherwise(F.array("identity"))
    held = nodes.select("id", "identity", own.alias("held"), "approved", "approved_by_identity")
    asked = rules.where(F.col("kind").isin("behaviour", "structure")).join(held, "id").withColumn("aim", F.coalesce("target", "identity"))
    out = asked.join(current.select(F.col("identity").alias("aim"), "facts", F.lit(True).alias("found")), "aim", "left")
    structure = F.col("kind") == "structure"
    strange = F.col("target").isNotNull() & ~F.array_contains("held", F.col("target"))
    problem = F.when(structure, None).when(strange, F.concat(F.lit("rule target "), "target", F.lit(" does not match node identity "), "identity")).when(F.col("found").isNull(), F.concat("aim", F.lit(" is missing from the current project")))
    usable = ~structure & problem.isNull()
    snapshot = F.coalesce(F.try_element_at("approved_by_identity", F.col("aim")), F.when(F.col("aim") == F.col("identity"), F.col("approved")))
    return out.select("id", "place", F.when(structure, F.col("target")).otherwise(F.col("aim")).alias("target"), problem.alias("problem"), structure.alias("unsupported"), F.when(usable, F.col("facts")).alias("facts"), F.when(usable, snapshot).alias("approved"))
