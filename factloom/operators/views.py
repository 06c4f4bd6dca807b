"""View models: statuses, coverage, previews, folding, layout and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses from the worst to the best; superseded does not count.
SEVERITY = ("error", "drifted", "intended", "approved", "implemented")
FEATURE_SEVERITY = ("drifted", "error", "intended", "approved", "implemented")


def severity(status: Column, order=SEVERITY) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(order)])


def feature_status(nodes: DataFrame) -> DataFrame:
    """feature, status: the worst of its nodes' statuses, superseded left out, intended without any."""
    worst = F.min(F.when(F.col("status") != "superseded", severity(F.col("status"), FEATURE_SEVERITY)))
    named = F.coalesce(*[F.when(F.col("w") == i, F.lit(s)) for i, s in enumerate(FEATURE_SEVERITY)], F.lit("intended"))
    return nodes.groupBy("feature").agg(worst.alias("w")).select("feature", named.alias("status"))


def lens_coverage(lenses: DataFrame, nodes: DataFrame) -> DataFrame:
    """lens, n: nodes tagged with each lens, zero included."""
    tags = nodes.select(F.explode(F.array_distinct("lens_tags")).alias("lens")).groupBy("lens").agg(F.count("*").alias("n"))
    return lenses.join(tags, "lens", "left").select("lens", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status_pivot(nodes: DataFrame, by: str, statuses: list[str]) -> DataFrame:
    return nodes.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def preview(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """Each group's first, last and evenly spaced rows, ``limit`` at most (halves round up), but the first and last always."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    between = F.transform(F.sequence(F.lit(0), F.lit(max(limit, 2) - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / (max(limit, 2) - 1) + 0.5).cast("int"))
    picks = between if limit > 1 else F.array(F.lit(0), F.col("_n").cast("int") - 1)
    return numbered.where((F.col("_n") <= limit) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def chunks(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``chunk``: runs of ``size`` within a group, from 0."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("chunk", F.floor((n - 1) / size).cast("int"))


def batches(rows: DataFrame, order: list[str], size: int, directory: str) -> DataFrame:
    """``rows`` with ``batch`` (from 0), runs of ``size`` in one order over all rows, and ``batch_name``.

    The name is the batch's directory, or its first one and how many more there are. Places come from range partitions'
    totals, so no task sees all rows.
    """
    from .events import with_rank
    from .graph import reliable

    placed = reliable(with_rank(rows, order).withColumn("batch", F.floor(F.col("rank") / size)))
    names = placed.groupBy("batch").agg(F.min_by(directory, "rank").alias("_first"), F.count_distinct(directory).alias("_n"))
    name = F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.concat("_first", F.lit(" +"), (F.col("_n") - 1).cast("string"), F.lit(" more")))
    return placed.join(names.select("batch", name.alias("batch_name")), "batch").drop("rank")


def fold_runs(rows: DataFrame, group: str, order: str, shown: Column) -> DataFrame:
    """group, first, shown, n: every shown row by itself and every maximal run of others as one (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(order)
    flagged = rows.select(group, order, shown.alias("shown"))
    border = F.col("shown") | F.coalesce(F.lag("shown").over(w), F.lit(True))
    island = flagged.withColumn("_b", border.cast("int")).withColumn("_island", F.sum("_b").over(w))
    return island.groupBy(group, "_island").agg(F.min(order).alias("first"), F.bool_or("shown").alias("shown"), F.count("*").alias("n")).drop("_island")


def layout(rows: DataFrame, group: str, order: list[str], height: str) -> DataFrame:
    """``rows`` with ``top`` (sum of the heights before) and ``next_top``."""
    w = Window.partitionBy(group).orderBy(*order)
    top = F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("top", top)
    return placed.withColumn("next_top", F.lead("top").over(w))


def next_marked(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, following: the next row of the group in a cycle."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.first(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(group, order, F.coalesce(F.lead(order).over(w), first).alias("following"))


def find_steps(rows: DataFrame, query: str, fields: list[str], order: list[str], limit: int = 8) -> DataFrame:
    """The first ``limit`` rows in plan order of which some field holds the query, whatever the case."""
    hay = F.exists(F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields]), lambda x: F.contains(x, F.lit(query.lower())))
    return rows.where(hay).orderBy(*order).limit(limit)


def feature_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """from, to: step edges lifted to their features, distinct, without loops."""
    a = owners.select(F.col("id").alias("from"), F.col("feature").alias("f"))
    b = owners.select(F.col("id").alias("to"), F.col("feature").alias("t"))
    return edges.join(a, "from").join(b, "to").where("f <> t").select(F.col("f").alias("from"), F.col("t").alias("to")).distinct()


def heading_prefixes(rows: DataFrame, by: str, path: str) -> DataFrame:
    """by, heading: every prefix of the rows' heading paths."""
    all_prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), " > "))
    return rows.where(F.size(path) > 0).select(by, F.explode(all_prefixes).alias("heading")).distinct()


def first_spellings(rows: DataFrame, word: str, seq: str = "seq") -> DataFrame:
    """key, spelling: of words equal but for case, the first spelling."""
    return rows.groupBy(F.lower(word).alias("key")).agg(F.min_by(word, seq).alias("spelling"))


def fallback_tags(text: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """The tags, in vocabulary order, of which some word occurs in the text, whatever the case."""
    low = F.lower(text)
    hit = lambda words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in words], F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(tag)) for tag, words in vocabulary.items()]))


# Steps that a feature shows without folding, and steps of an unnamed range.
FLAT, RANGE = 12, 10


def in_step_order(rows: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """``rows`` with ``place`` (from 1): numbered steps by number and id, then the others as they come."""
    order = [F.col("step").isNull(), "step", F.when(F.col("step").isNotNull(), F.col("id").cast("string")), seq]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def parts_of(rows: DataFrame, group: str = "feature", seq: str = "seq") -> DataFrame:
    """group, id, place, part (from 1), part_name, number of every step.

    A feature of more than FLAT steps is cut into parts by their first heading, in the order in which these come, steps
    without one last; if that gives one part only, into ranges of RANGE. A step is numbered by its part and its place in it.
    """
    w = Window.partitionBy(group)
    heading = F.coalesce(F.get("path", F.lit(0)), F.lit(""))
    placed = in_step_order(rows, group, seq).select(group, "id", "place", heading.alias("heading")).withColumn("n", F.count("*").over(w))
    first = placed.groupBy(group, "heading").agg(F.min("place").alias("first"))
    ranked = first.withColumn("part", F.row_number().over(w.orderBy(F.col("heading") == "", "first"))).withColumn("parts", F.count("*").over(w))
    out = placed.join(ranked, [group, "heading"])
    start = F.floor((F.col("place") - 1) / RANGE) * RANGE
    by_range = F.concat(F.lit("Steps "), (start + 1).cast("string"), F.lit("–"), F.least(start + RANGE, F.col("n")).cast("string"))
    name = F.when(F.col("parts") == 1, by_range).when(F.col("heading") == "", "Other steps").otherwise(F.col("heading"))
    part = F.when(F.col("parts") == 1, (start / RANGE + 1).cast("int")).otherwise(F.col("part"))
    flat = F.col("n") <= FLAT
    out = out.select(group, "id", "place", F.when(~flat, part).alias("part"), F.when(~flat, name).alias("part_name"))
    inside = Window.partitionBy(group, "part")
    at, size = F.row_number().over(inside.orderBy("place")).cast("string"), F.count("*").over(inside)
    number = F.when(F.col("part").isNull(), F.col("place").cast("string")).when(size == 1, F.col("part").cast("string")).otherwise(F.concat(F.col("part").cast("string"), F.lit("."), at))
    return out.withColumn("number", number)


def constellation(features: DataFrame, nodes: DataFrame, lens_order: list[str]) -> DataFrame:
    """feature, place (of those with steps, by seq), steps, parts, sub, lenses, failing, status, setup (nodes of a feature without steps).

    ``features`` has feature and seq; ``nodes`` id, feature, role, status, step, path, lens_tags, seq.
    """
    steps = nodes.where("role = 'behaviour'")
    counts = steps.groupBy("feature").agg(F.count("*").alias("steps"))
    parts = parts_of(steps).groupBy("feature").agg(F.count_distinct("part").alias("parts"))
    tags = F.flatten(F.collect_set(F.coalesce("lens_tags", F.array().cast("array<string>"))))
    facts = nodes.groupBy("feature").agg(F.count("*").alias("members"), F.count_if(F.col("status").isin("drifted", "error")).alias("failing"), *[F.max(F.coalesce(F.array_contains("lens_tags", x), F.lit(False))).alias(f"_lens{i}") for i, x in enumerate(lens_order)])
    lenses = F.array_compact(F.array(*[F.when(F.col(f"_lens{i}"), F.lit(x)) for i, x in enumerate(lens_order)]))
    out = features.join(counts, "feature", "left").join(parts, "feature", "left").join(facts, "feature", "left").join(feature_status(nodes), "feature", "left")
    shown = F.col("steps").isNotNull()
    place = F.when(shown, F.row_number().over(Window.partitionBy(shown).orderBy("seq")))  # one row a feature
    sub = F.when(F.col("parts") > 1, F.concat(F.col("steps"), F.lit(" steps · "), F.col("parts"), F.lit(" parts"))).when(F.col("steps") == 1, "1 step").otherwise(F.concat(F.col("steps"), F.lit(" steps")))
    return out.select(
        "feature", place.alias("place"), F.coalesce("steps", F.lit(0)).alias("steps"), F.when(shown, sub).alias("sub"), F.when(shown, lenses).alias("lenses"),
        F.when(shown, F.col("failing")).alias("failing"), F.when(shown, F.col("status")).alias("status"), F.when(~shown, F.coalesce("members", F.lit(0))).alias("setup"),
    )


def outline(rows: DataFrame) -> DataFrame:
    """id, feature, shown: each row's headings without those levels that hold one thing only.

    ``rows`` has id, feature and path; a level is told from one of the same name by all that stands above it.
    """
    path = F.filter(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    own = rows.select("id", F.coalesce(F.nullif("feature", F.lit("")), F.lit("Unclassified")).alias("feature"), path.alias("path"))
    levels = own.where(F.size("path") > 0).select("feature", "id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    levels = levels.select("feature", "id", "depth", F.slice("path", F.lit(1), F.col("depth")).alias("level"), F.when(F.col("depth") < F.size("path"), F.element_at("path", F.col("depth") + 1)).alias("below"))
    child = F.struct("below", F.when(F.col("below").isNull(), F.col("id")).alias("row"))
    branching = levels.groupBy("feature", "level").agg(F.min(child).alias("a"), F.max(child).alias("b")).where("not a <=> b").select("feature", "level")
    kept = levels.join(branching, ["feature", "level"]).groupBy("feature", "id").agg(F.array_sort(F.collect_list(F.struct("depth", F.element_at("level", -1).alias("name")))).alias("kept"))
    shown = F.coalesce(F.transform("kept", lambda x: x["name"]), F.array().cast("array<string>"))
    return own.join(kept, ["feature", "id"], "left").select("id", "feature", shown.alias("shown"))


def vocabulary_places(words: DataFrame, vocabulary: list[str], palette: list[str]) -> DataFrame:
    """word, place, colour of the distinct words that the vocabulary has, by its order."""
    known = F.array(*map(F.lit, vocabulary))
    place = F.array_position(known, F.col("word")) - 1
    colours = F.array(*map(F.lit, palette))
    return words.select("word").distinct().where(F.array_contains(known, F.col("word"))).select("word", place.cast("int").alias("place"), F.get(colours, F.pmod(place, F.lit(len(palette))).cast("int")).alias("colour"))


def view_state(rows: DataFrame) -> DataFrame:
    """``rows`` (has_project, has_plan, plan_valid) with ``state``: missing, no-plan, invalid-plan or ready."""
    state = F.when(~F.col("has_project"), "missing").when(~F.col("has_plan"), "no-plan").when(~F.col("plan_valid"), "invalid-plan").otherwise("ready")
    return rows.withColumn("state", state)
