"""Plan lifecycle and lookups around it: approval, revision, ordering, ownership, vocabulary and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .views import SEVERITY, severity


def approve(nodes: DataFrame, chosen: Column, who: str, facts: str = "facts") -> DataFrame:
    """Intended nodes among ``chosen`` become approved with a snapshot of their facts; approved ones stay as they are."""
    now = chosen & (F.col("status") == "intended")
    return nodes.withColumns({"approved_by": F.when(now, F.lit(who)).otherwise(F.col("approved_by")), "approved_facts": F.when(now, F.col(facts)).otherwise(F.col("approved_facts")), "status": F.when(now, "approved").otherwise(F.col("status"))})


def revise(nodes: DataFrame, chosen: Column) -> DataFrame:
    """Approved nodes among ``chosen`` become intended again, one version on, without snapshot."""
    now = chosen & (F.col("status") == "approved")
    none = lambda c: F.when(~now, F.col(c))
    return nodes.withColumns({"version": F.col("version") + now.cast("int"), "approved_by": none("approved_by"), "approved_facts": none("approved_facts"), "status": F.when(now, "intended").otherwise(F.col("status"))})


def reject(nodes: DataFrame, chosen: Column) -> DataFrame:
    """All nodes but the first of ``chosen`` in the plan's order (``seq``); without a chosen one all stay."""
    first = F.broadcast(nodes.where(F.coalesce(chosen, F.lit(False))).agg(F.min("seq").alias("_first")))  # one row
    return nodes.join(first, F.col("seq") == F.col("_first"), "left_anti")


def named_by(target: str) -> Column:
    """Whether a node is meant by ``target``: by its id, its identity or one of its identities."""
    return (F.col("id").cast("string") == target) | F.coalesce(F.array_contains(F.col("identities").cast("array<string>"), target), F.lit(False))


def reorder(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """Steps renumbered 1..N per feature after moves (id, place): a moved node stands before what had its place; missing steps last."""
    placed = nodes.join(moved, "id", "left")
    key = F.when(F.col("place").isNotNull(), F.col("place") - 0.5).otherwise(F.col("step").cast("double"))
    n = F.row_number().over(Window.partitionBy("feature").orderBy(F.coalesce(key, F.lit(float("inf"))), "id"))
    return placed.withColumn("step", n).drop("place")


def next_number(ids: DataFrame, column: str) -> DataFrame:
    """One row: the largest numeric suffix plus one, from 1."""
    return ids.agg((F.coalesce(F.max(F.regexp_extract(column, "([0-9]+)$", 1).try_cast("long")), F.lit(0)) + 1).alias("next"))


def declaration_map(baseline: DataFrame, current: DataFrame, key: str = "identity") -> DataFrame:
    """Baseline and current declarations as one, current ones first."""
    both = baseline.withColumn("_at", F.lit(0)).unionByName(current.withColumn("_at", F.lit(1)))
    rest = [c for c in baseline.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("d")).select(key, *[F.col(f"d.{c}").alias(c) for c in rest])


def apply_verification(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """seq, identity, status: each identity's latest row takes its result, older rows are superseded, others stay."""
    n = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("ts"), F.desc("seq")))
    rows = nodes.withColumn("_n", n).join(results.select("identity", F.col("status").alias("verdict")), "identity", "left")
    status = F.when(F.col("_n") > 1, "superseded").when(F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))
    return rows.select("seq", "identity", status.alias("status"))


def effective_status(nodes: DataFrame, verified: DataFrame) -> DataFrame:
    """id, status: the worst verdict (error, drifted) of a node's identities at its version, else its own status."""
    each = nodes.select("id", "version", F.explode("identities").alias("identity"))
    hits = each.join(verified.select("identity", "version", F.col("status").alias("verdict")), ["identity", "version"])
    worst = hits.groupBy("id").agg(F.min(severity(F.col("verdict"))).alias("w"))
    named = F.coalesce(*[F.when(F.col("w") == i, F.lit(s)) for i, s in enumerate(SEVERITY)], F.col("status"))
    return nodes.join(worst, "id", "left").select("id", named.alias("status"))


def row_status(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """identity, status: a node's verdict for one declaration: error or drifted only where its own items say so."""
    each = nodes.select("id", F.explode("identities").alias("identity"))
    own = results.select("id", "identity", "is_error", "is_violation")
    marks = each.join(own, ["id", "identity"], "left").groupBy("id", "identity").agg(F.max("is_error").alias("e"), F.max("is_violation").alias("v"))
    return marks.select("id", "identity", F.when(F.col("e"), "error").when(F.col("v"), "drifted").otherwise("implemented").alias("status"))


def link_steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """from, to: the steps that a step's calls lead to, other than itself.

    ``nodes`` has id, identities and ``seq``, the plan's order. A call comes from every node that has its caller; it leads to
    the last node of the plan that has what is called. Called nodes come first, as each caller's nodes make a row more; nothing
    is gathered before the pairs are dealt out, as few of them repeat.
    """
    from .skew import spread

    each = nodes.select("id", "seq", F.explode("identities").alias("identity"))
    owners = each.groupBy(F.col("identity").alias("to")).agg(F.max_by("id", "seq").alias("b"))
    callers = each.select(F.col("identity").alias("from"), F.col("id").alias("a"))
    total = edges.count()
    led = spread(edges.select("from", "to").join(owners, "to").select("from", "b"), "from", total=total)
    pairs = led.join(callers, "from").where("a <> b").select(F.col("a").alias("from"), F.col("b").alias("to"))
    return spread(pairs, "from", "to", total=3 * total).distinct()


def first_by_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of sources, one row a key: the first source that has it."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    rest = [c for c in sources[0].columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest, "_source"), "_source").alias("d")).select(key, *[F.col(f"d.{c}").alias(c) for c in rest], F.col("d._source").alias("source"))


def uncovered(candidates: DataFrame, covered: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    return candidates.join(covered.select(key), key, "left_anti").join(protected.select(key), key, "left_anti")


def canonical(value: Column, vocabulary: list[str], synonyms: dict[str, str]) -> Column:
    """A vocabulary word for a spelling (trimmed, lower-cased, hyphenated), by itself or by synonym; else null."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"[\s_]+", "-")
    known = F.element_at(F.create_map(*[F.lit(x) for v in vocabulary for x in (v, v)], *[F.lit(x) for p in synonyms.items() for x in p]), plain)
    return F.when(F.array_contains(F.array(*map(F.lit, [*vocabulary, *synonyms])), plain), known)


# Verbs that say nothing at the start of a title; words that name layers and not features.
PLACEHOLDER_VERBS = "handle|process|manage|execute|perform|run|do|support|implement|ensure|deal with|take care of"
LENSES = ("frontend", "backend", "database", "security")
LAYER_NAMES = (
    *LENSES, "interface", "server", "safety", "data", "ui", "client", "api", "db", "infrastructure", "infra", "platform", "integration", "middleware", "controller", "service", "services", "utils", "utilities", "helpers",
    "misc", "miscellaneous", "core", "general", "common", "shared", "operations", "ops", "management", "handling", "processing", "logic", "functionality", "features", "components", "modules",
)
# Spellings of roles.
ROLE_SYNONYMS = {
    "behaviour": "step steps action operation workflow behavior behaviours behaviors", "vocabulary": "data constant constants schema schemas model type types enum terms term definition definitions",
    "machinery": "setup config configuration bootstrap startup start-up infrastructure infra platform plumbing lifecycle precondition", "tool": "helper helpers utility utilities util utils formatter shared",
}


def is_layer_name(value: Column) -> Column:
    """Whether a text only names a layer of a program."""
    return F.coalesce(F.lower(F.trim(value)).isin(*LAYER_NAMES), F.lit(False))


def canonical_lenses(values: Column, vocabulary: list[str], synonyms: dict[str, str]) -> Column:
    """The vocabulary words that some of the spellings mean, in vocabulary order."""
    meant = F.transform(values, lambda v: canonical(v, vocabulary, synonyms))
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(meant, v))


def canonical_role(value: Column) -> Column:
    return canonical(value, list(ROLE_SYNONYMS), {s: role for role, some in ROLE_SYNONYMS.items() for s in some.split()})


def member_names(identities: Column) -> Column:
    """The code-shaped names (whole and by part, three characters or more) of the declarations."""
    name = lambda i: F.regexp_replace(F.substring_index(F.substring_index(i, "::", 2), "::", -1), ":[^:]*$", "")
    parts = F.flatten(F.transform(identities, lambda i: F.concat(F.array(name(i)), F.split(name(i), r"\."))))
    return F.filter(F.array_distinct(parts), lambda n: (F.length(n) >= 3) & n.rlike(r"[_.()]|[a-z][A-Z]"))


def names_function(title: Column, name: Column) -> Column:
    """Whether a title holds a name as a whole word, whatever the case."""
    pattern = F.concat(F.lit(r"(?i)(?:^|[^A-Za-z0-9_])\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit(r"\E(?:[^A-Za-z0-9_]|$)"))
    return F.regexp_like(title, pattern)


def title_problem(title: Column, identities: Column) -> Column:
    """Why a title is refused: empty, longer than 12 words, opening with a placeholder verb, or naming a declaration."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    return (
        F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, "empty").when(F.size(words) > 12, "too long")
        .when(F.trim(title).rlike(f"(?i)^(?:{PLACEHOLDER_VERBS})\\b"), "placeholder verb").when(F.exists(member_names(identities), lambda n: names_function(title, n)), "names code")
    )


def drop_repeated(readings: DataFrame, lens: str, text: str, order: str) -> DataFrame:
    """The first holder of a (lens, normalised text) keeps it; empty and placeholder texts go."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    rows = readings.withColumn("_key", plain).where(~F.col("_key").rlike(r"^(|none|n/a|not applicable\.?)$"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(lens, "_key").orderBy(order))).where("_n = 1").drop("_n", "_key")


def identical_sessions(entries: DataFrame) -> DataFrame:
    """session, same_as: the earliest earlier session of the same reason with equal entries.

    Entries are compared by their count and the sums of two 64-bit hashes, whatever their order, so no session is gathered.
    """
    total = lambda *salt: F.sum(F.xxhash64(*[F.lit(x) for x in salt], "entry").cast("decimal(38,0)"))
    per = entries.groupBy("session", "reason").agg(F.struct(F.count("*").alias("n"), total().alias("a"), total("again").alias("b")).alias("digest"))
    first = per.groupBy("reason", "digest").agg(F.min("session").alias("same_as"))
    return per.join(first, ["reason", "digest"]).where("same_as < session").select("session", "same_as")


def common_prefix(paths: DataFrame, group: str, path: str) -> DataFrame:
    """group, prefix: the longest list prefix that all of a group's paths share."""
    low, high = F.min(path).alias("a"), F.max(path).alias("b")  # the least and the greatest share what all share
    ends = paths.groupBy(group).agg(low, high)
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    size = F.size(F.filter(same, lambda x: x))
    return ends.select(group, F.slice("a", F.lit(1), size).alias("prefix"))


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """importer, module, dots, target, confidence of Python imports: module file before package, dots walk up directories.

    An absolute module whose first segment is a module or package at the top of the project is inferred; others are unresolved.
    """
    parts = F.split("importer", "/")
    base = F.when(F.col("dots") > 0, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("dots"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    outside = F.col("dots") > F.size(parts)
    steps = F.concat(base, F.filter(F.split("module", r"\."), lambda x: x != ""))
    stem = F.array_join(steps, "/")
    wanted = imports.withColumns({"_stem": F.when(~outside, stem), "_top": F.element_at(F.split("module", r"\."), 1)})
    tried = wanted.select("importer", "module", "dots", F.posexplode(F.array(F.concat("_stem", F.lit(".py")), F.concat("_stem", F.lit("/__init__.py")))).alias("pos", "path"))
    hits = tried.join(files.select("path"), "path").groupBy("importer", "module", "dots").agg(F.min_by("path", "pos").alias("target"))
    own = files.where(F.col("path").rlike(r"^[^/]+(\.py|/__init__\.py)$"))
    tops = own.select(F.regexp_replace("path", r"(\.py|/__init__\.py)$", "").alias("_top")).distinct().withColumn("_ours", F.lit(True))
    out = wanted.join(hits, ["importer", "module", "dots"], "left").join(tops, "_top", "left")
    sure = F.when(F.col("target").isNotNull(), "certain").when((F.col("dots") == 0) & F.col("_ours"), "inferred").otherwise("unresolved")
    return out.select("importer", "module", "dots", "target", sure.alias("confidence"))
