"""Evolution rows: labels, statuses, the lineage forest, and views of its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import numbered_id, with_rank
from .graph import reliable


def apply_labels(rows: DataFrame, labels: DataFrame, fallback: Column, refused: list[str]) -> DataFrame:
    """ts, identity, label, source: rows already labelled stay; else the model's label unless refused, else the fallback."""
    given = labels.select("ts", "identity", F.col("label").alias("given"))
    out = rows.join(given, ["ts", "identity"], "left")
    usable = F.col("given").isNotNull() & ~F.lower("given").isin(*refused)
    label = F.when(F.col("label").isNotNull(), F.col("label")).when(usable, F.col("given")).otherwise(fallback)
    source = F.when(F.col("label").isNotNull(), "kept").when(usable, "model").otherwise("fallback")
    return out.select("ts", "identity", label.alias("label"), source.alias("source"))


def apply_rule_status(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """seq, identity, status: verified rows stay; a row whose identity has an approved rule is approved, with any rule intended."""
    state = F.when(F.bool_or("approved"), "approved").otherwise("intended")
    per = rules.groupBy(F.col("target").alias("identity")).agg(state.alias("by_rule"))
    out = rows.join(per, "identity", "left")
    return out.select("seq", "identity", F.when(F.col("verified"), F.col("status")).otherwise(F.coalesce("by_rule", "status")).alias("status"))


def _looping(links: DataFrame) -> DataFrame:
    """ids of (id, up) rows whose chain of ``up`` never ends.

    Each round doubles the length of the jumps, so rows whose chain ends there drop out. As long as some are left, a shorter
    chain's row drops out in every round; when none does, the rest lead into loops.
    """
    jump = reliable(links.where("up is not null"))
    n = jump.count()
    while n:
        on = jump.select(F.col("id").alias("up"), F.col("up").alias("further"))
        jump = reliable(jump.join(on, "up").select("id", F.col("further").alias("up")))
        now = jump.count()
        if now == n:
            break
        n = now
    return jump.select("id")


def forest(rows: DataFrame) -> DataFrame:
    """id, root, depth: parents count within one feature only; a row whose chain leads into a loop hangs under no one.

    Pointer doubling: each round doubles the known part of every chain, so the rounds grow with the logarithm of the depth.
    """
    up = rows.select(F.col("id").alias("parent"), F.col("feature").alias("parent_feature"))
    found = reliable(rows.join(up, "parent", "left").select("id", "feature", "parent_feature", F.when(F.col("parent_feature").isNotNull(), F.col("parent")).alias("up")))
    sound = found.join(_looping(found.select("id", "up")).withColumn("loops", F.lit(True)), "id", "left")
    links = sound.select("id", F.when(F.col("loops").isNull() & (F.col("feature") == F.col("parent_feature")), F.col("up")).alias("up"))
    reach = reliable(links.select("id", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("long").alias("depth")))
    while True:
        on = reach.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        step = reliable(reach.join(on, "root").select("id", F.col("further").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        reach = step.drop("moved")
        if step.where("moved").isEmpty():
            return reach.withColumn("depth", F.col("depth").cast("int"))


def call_arcs(edges: DataFrame, node, visible: DataFrame) -> DataFrame:
    """other, direction of a node's edges among the visible nodes."""
    ins = edges.where(F.col("to") == node).select(F.col("from").alias("other"), F.lit("in").alias("direction"))
    outs = edges.where(F.col("from") == node).select(F.col("to").alias("other"), F.lit("out").alias("direction"))
    return ins.unionByName(outs).distinct().join(visible.select(F.col("id").alias("other")), "other", "left_semi")


def with_order_edges(lifted: DataFrame, features: DataFrame, order: list[str]) -> DataFrame:
    """from, to, kind: lifted edges as calls, and an order edge to the next feature where no call leads there."""
    ranked = with_rank(features.select("feature", *[c for c in order if c != "feature"]), order)
    after = ranked.select(F.col("feature").alias("to"), (F.col("rank") - 1).alias("rank"))
    following = ranked.select(F.col("feature").alias("from"), "rank").join(after, "rank").drop("rank")
    extra = following.join(lifted.select("from", "to"), ["from", "to"], "left_anti")
    return lifted.select("from", "to", F.lit("call").alias("kind")).unionByName(extra.select("from", "to", F.lit("order").alias("kind")))


def in_feature_order(rows: DataFrame, ranks: DataFrame, seq: str) -> DataFrame:
    """``rows`` with ``place`` by their feature's rank (any case), unranked last, otherwise as they come."""
    named = ranks.select(F.lower("name").alias("_key"), F.col("rank").alias("_rank"))
    out = rows.join(named, F.lower("feature") == F.col("_key"), "left").withColumn("_rank", F.coalesce("_rank", F.lit(2**31 - 1)))
    return with_rank(out, ["_rank", seq]).withColumn("place", (F.col("rank") + 1).cast("int")).drop("_key", "_rank", "rank")


def insert_missing(known: DataFrame, wanted: DataFrame, name: str, prefix: str) -> DataFrame:
    """id, name of the wanted words that are not known (any case), numbered after the known ones."""
    fresh = wanted.groupBy(F.lower(name).alias("_key")).agg(F.min_by(name, "seq").alias(name), F.min("seq").alias("seq"))
    fresh = fresh.join(known.select(F.lower(name).alias("_key")), "_key", "left_anti")
    return with_rank(fresh, ["seq"]).select(numbered_id(prefix, F.col("rank") + 1 + known.count()).alias("id"), name)


def label_errors(given: DataFrame, asked: DataFrame, most_words: int, forbidden: list[str]) -> DataFrame:
    """pos, error of labels that do not answer the asked row in their place, are too long or use a forbidden name."""
    both = asked.select("pos", "ts", "identity").join(given.select("pos", F.col("ts").alias("ts2"), F.col("identity").alias("identity2"), "label"), "pos", "full_outer")
    wrong = ~(F.col("ts").eqNullSafe(F.col("ts2")) & F.col("identity").eqNullSafe(F.col("identity2")))
    long = F.size(F.filter(F.split(F.coalesce("label", F.lit("")), " "), lambda w: w != "")) > most_words
    checks = F.array(F.when(wrong, "out of place"), F.when(long, "too long"), F.when(F.lower("label").isin(*forbidden), "forbidden"))
    return both.select("pos", F.explode(F.array_compact(checks)).alias("error"))


def scan_progress(lines: DataFrame) -> DataFrame:
    """run, total, batches, last_batch from ordered progress lines such as ``found 284 declarations`` and ``batch 3/10``."""
    grab = lambda p, g: F.regexp_extract("line", p, g).try_cast("int")
    return lines.groupBy("run").agg(F.max(grab(r"found (\d+) declarations", 1)).alias("total"), F.max(grab(r"batch (\d+)/(\d+)", 2)).alias("batches"), F.max(grab(r"batch (\d+)/(\d+)", 1)).alias("last_batch"))


def call_chips(edges: DataFrame, node, inside: DataFrame) -> DataFrame:
    """other, direction, inside: who a node calls and who calls it, and whether that is one of the rows that are shown with it."""
    ends = edges.where(F.col("to") == node).select(F.col("from").alias("other"), F.lit("in").alias("direction")).unionByName(edges.where(F.col("from") == node).select(F.col("to").alias("other"), F.lit("out").alias("direction")))
    return ends.distinct().join(inside.select(F.col("id").alias("other"), F.lit(True).alias("inside")).distinct(), "other", "left").fillna(False, ["inside"])


#: Tags that a row keeps.
TAGS = 3


def cleaned_labels(labels: DataFrame, spellings: DataFrame) -> DataFrame:
    """``labels`` (pos, tags, path) with tags in their first spelling, each once and TAGS at most, and paths without a heading that repeats the one above.

    ``spellings`` has key (lower case) and spelling; a tag that has none stays as it is.
    """
    each = labels.select("pos", F.posexplode("tags").alias("at", "tag")).join(spellings, F.lower("tag") == F.col("key"), "left")
    once = each.select("pos", "at", F.coalesce("spelling", "tag").alias("tag")).groupBy("pos", "tag").agg(F.min("at").alias("at"))
    kept = once.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("t")).select("pos", F.transform(F.slice("t", 1, TAGS), lambda x: x["tag"]).alias("clean"))
    path = F.filter("path", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("path", i - 1)))
    none = F.array().cast("array<string>")
    return labels.join(kept, "pos", "left").withColumns({"tags": F.coalesce("clean", none), "path": F.coalesce(path, none)}).drop("clean")


def vocabulary(owned: DataFrame, seen: DataFrame, word: str) -> DataFrame:
    """The plan's own words if it has any, else the distinct words of finished rows in their first spelling (by seq)."""
    from .views import first_spellings

    if not owned.isEmpty():
        return owned.select(word)
    return first_spellings(seen.where("finished"), word).select(F.col("spelling").alias(word))
