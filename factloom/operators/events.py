"""Event log: deduplication, net deltas, sessions, lineage and evolution."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reliable
from .skew import hot_join


def _by(key: str, seq: str = "seq"):
    return Window.partitionBy(key).orderBy(seq)


def dedupe_consecutive(events: DataFrame, same: list[str], key: str = "identity") -> DataFrame:
    """Drops an event equal to the identity's previous one (runs collapse, so the raw predecessor decides)."""
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(_by(key)))
    first = F.row_number().over(_by(key)) == 1
    return events.withColumn("_keep", first | ~equal).where("_keep").drop("_keep")


def new_changes(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Incoming changes without those added or deleted that the history has by identity and type."""
    known = history.where(F.col("type").isin("added", "deleted")).select("identity", "type").distinct()
    return incoming.join(known, ["identity", "type"], "left_anti")


def net_delta(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, before (first), after (last), event_count of rows (seq, before, after); what nets to nothing goes."""
    out = changes.groupBy(*keys).agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"), F.count("*").alias("event_count"))
    return out.where(~F.col("before").eqNullSafe(F.col("after")))


def time_groups(events: DataFrame, gap_minutes: int, key: str) -> DataFrame:
    """``events`` with ``grp``: a new group when ``gap_minutes`` or more have passed since the key's previous event."""
    fresh = F.col("ts") - F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "seq")) >= F.expr(f"interval {gap_minutes} minutes")
    flagged = events.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1)))
    return flagged.withColumn("grp", F.sum("_new").over(Window.partitionBy(key).orderBy("ts", "seq"))).drop("_new")


def lineage(events: DataFrame) -> DataFrame:
    """seq, identity, type, parent: the seq of the latest earlier ``added`` of the identity; an ``added`` is an anchor."""
    anchor = F.last(F.when(F.col("type") == "added", F.col("seq")), ignorenulls=True).over(_by("identity").rowsBetween(Window.unboundedPreceding, -1))
    return events.select("seq", "identity", "type", F.when(F.col("type") != "added", anchor).alias("parent"))


def evolution_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New nodes of an insert-only merge: unseen (ts, identity, type), ids after the stored ones, parents by anchor, else latest.

    Ids follow seq order over all new rows; the count of earlier rows is a prefix sum over identities' ranges of seq.
    """
    fresh = incoming.join(stored.select("ts", "identity", "type"), ["ts", "identity", "type"], "left_anti")
    offset = stored.count()
    numbered = with_rank(fresh, ["seq"]).withColumn("id", numbered_id("n_", F.col("rank") + 1 + offset))
    both = stored.select("seq", "identity", "type", "id").withColumn("_new", F.lit(False)).unionByName(numbered.select("seq", "identity", "type", "id").withColumn("_new", F.lit(True)))
    before = _by("identity").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("type") == "added", F.col("id")), ignorenulls=True).over(before)
    parent = F.when(F.col("type") != "added", F.coalesce(anchor, F.last("id").over(before)))
    return both.withColumn("parent", parent).where("_new").select("id", "identity", "type", "parent")


def numbered_id(prefix: str, number: Column, width: int = 4) -> Column:
    """The prefix and the number with leading zeros; a number of more digits than ``width`` stays whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank``, the row's place (from 0) in a global order, without a single-task window over the rows.

    Rows are range-partitioned; partition totals give each partition's start.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(starts.drop("_n")), "_part").withColumn("rank", F.col("_start") + inside - 1).drop("_part", "_start")


def mark_superseded(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``superseded``: all but an identity's latest by ts (then seq)."""
    n = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("ts"), F.desc("seq")))
    return nodes.withColumn("superseded", n > 1)


def latest_verified(nodes: DataFrame) -> DataFrame:
    """identity, status of the last verified, not superseded row; the later row wins ties."""
    rows = nodes.where("verified and status <> 'superseded'")
    return rows.groupBy("identity").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def session_entries(events: DataFrame, deltas: DataFrame, session: str = "session") -> DataFrame:
    """session, identity, type (first), event_count, n_properties; a changed identity without a net delta goes."""
    per = events.groupBy(session, "identity").agg(F.min_by("type", "seq").alias("type"), F.count("*").alias("event_count"))
    counts = deltas.groupBy(session, "identity").agg(F.count("*").alias("n_properties"))
    out = per.join(counts, [session, "identity"], "left").withColumn("n_properties", F.coalesce("n_properties", F.lit(0)).cast("long"))
    return out.where("type <> 'changed' or n_properties > 0")


def sessions_from_markers(log: DataFrame, key: str) -> DataFrame:
    """``log`` rows that are events, with ``session``: the number of start markers so far; what precedes the first is left out."""
    n = F.sum((F.col("type") == "session_started").cast("int")).over(_by(key).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("session", n).where("session > 0 and type not in ('session_started', 'session_sealed')")


def interval_join(entries: DataFrame, events: DataFrame) -> DataFrame:
    """session, identity, type, seq, ts of the last event of each entry within its session's time, and the entry's net_delta if it has one."""
    e = events.select("identity", "type", "seq", "ts")
    own = ["net_delta"] if "net_delta" in entries.columns else []
    hits = entries.join(e, ["identity", "type"]).where("opened_at <= ts and ts <= sealed_at")
    last = hits.groupBy("session", "identity", "type").agg(F.max_by(F.struct("seq", "ts", *own), "seq").alias("e"))
    return last.select("session", "identity", "type", "e.*")


def describe_delta(prop: str, before: str, after: str):
    """Text of a change: what arrays gained and lost, else the two values."""
    gone, come = F.array_except(F.split(before, ","), F.split(after, ",")), F.array_except(F.split(after, ","), F.split(before, ","))
    listed = F.concat_ws(" ", F.when(F.size(come) > 0, F.concat(F.lit("+"), F.array_join(come, ","))), F.when(F.size(gone) > 0, F.concat(F.lit("-"), F.array_join(gone, ","))))
    plain = F.concat_ws(" -> ", F.coalesce(before, F.lit("none")), F.coalesce(after, F.lit("none")))
    return F.concat(F.col(prop), F.lit(": "), F.when(F.col(prop) == "calls", listed).otherwise(plain))


#: Limits of a session: distinct identities that seal it, and idle time.
CAP, IDLE = 20, dt.timedelta(minutes=30)


class SessionFold:
    """The session state machine over one key's ordered events; shared by batch and streaming."""

    def __init__(self, number: int = 0, last=None, identities=()):
        self.number, self.last, self.identities = number, last, set(identities)

    def place(self, ts, identity) -> int:
        """The session number (from 1) that an event falls into."""
        if self.number == 0 or len(self.identities) >= CAP or (self.last is not None and ts - self.last >= IDLE):
            self.number, self.identities = self.number + 1, set()
        self.last = ts
        self.identities.add(identity)
        return self.number


#: Events of a block in which capped sessions are looked for.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _full_at(entries: Column, most: int) -> Column:
    """The place of the entry with which (name, place) entries in order have ``most`` names; null with fewer."""
    at = lambda e, names: F.get(e, (F.array_position(names, F.get(F.array_distinct(names), F.lit(most - 1))) - 1).cast("int"))["place"]
    return _let(entries, lambda e: _let(F.transform(e, lambda x: x["name"]), lambda names: at(e, names)))


def _first_names(entries: Column, most: int) -> Column:
    """Of (name, place) entries in order the first of each name, ``most`` at most."""
    names = F.transform(entries, lambda e: e["name"])
    return F.transform(F.slice(F.array_distinct(names), 1, most), lambda n: F.get(entries, (F.array_position(names, n) - 1).cast("int")))


def _session_starts(placed: DataFrame, cap: int) -> DataFrame:
    """place of the events that open a session; ``placed`` has place, name and fresh (opens a stretch without idle gap).

    A session that opens at an event is full at the event where the ``cap``-th name falls, and the next one opens behind that. So
    every event has a successor, which follows from the first places of the next names: lists of ``cap`` entries, which are put
    together from blocks and, by doubling, from the blocks behind them until they are full. The events that open sessions
    are those that the stretches' first events reach along successors; each round doubles the steps. No task sees a stretch.
    """
    stretch = with_running_sum(placed.select("place", "name", "fresh"), ["place"], F.col("fresh").cast("long"), "stretch")
    entry = F.struct("place", "name")
    blocks = reliable(stretch.groupBy("stretch", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("own")))  # BLOCK events at most
    ahead, step = reliable(blocks.select("stretch", "block", _first_names(F.col("own"), cap).alias("names"))), 1
    while True:
        further = ahead.select("stretch", (F.col("block") - step).alias("block"), F.col("names").alias("more"))
        short = ahead.where(F.size("names") < cap).join(further, ["stretch", "block"])
        if short.isEmpty():
            break
        grown = F.when(F.col("more").isNotNull() & (F.size("names") < cap), _first_names(F.concat("names", "more"), cap)).otherwise(F.col("names"))
        ahead, step = reliable(ahead.join(further, ["stretch", "block"], "left").select("stretch", "block", grown.alias("names"))), step * 2
    behind = ahead.select("stretch", (F.col("block") - 1).alias("block"), F.col("names").alias("behind"))
    tail = F.coalesce("behind", F.slice("own", 1, 0))
    successors = F.transform("own", lambda e, i: F.struct(e["place"].alias("place"), (_full_at(F.concat(F.slice("own", i + 1, F.lit(BLOCK)), tail), cap) + 1).alias("next")))
    hops = reliable(blocks.join(behind, ["stretch", "block"], "left").select(F.explode(successors).alias("h")).select("h.*").where("next is not null"))
    starts = reliable(placed.where("fresh").select("place"))
    while True:
        reached = reliable(hops.join(starts, "place").select(F.col("next").alias("place")).distinct().join(starts, "place", "left_anti"))
        if reached.isEmpty():
            return starts
        starts = reliable(starts.unionByName(reached))
        hops = reliable(hops.join(hops.select(F.col("place").alias("next"), F.col("next").alias("after")), "next").select("place", F.col("after").alias("next")))


def _opened(rows: DataFrame, key: str, identity: str, order: list[str], control: Column) -> DataFrame:
    """``rows`` with place (a global order by key), name, follows (the row before is of the key), opens (a session starts here).

    Rows of ``control`` end what is open and open nothing themselves.
    """
    ranked = reliable(with_rank(rows.withColumn("_control", control), [key, *order]))
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.lit(True).alias("_any"), F.col(key).alias("_key"), F.col("ts").alias("_ts"), F.col("_control").alias("_ended"))
    near = ranked.join(before, "rank", "left")
    follows = F.col("_any").isNotNull() & F.col(key).eqNullSafe(F.col("_key"))
    idle = F.col("ts") - F.col("_ts") >= F.expr(f"interval {int(IDLE.total_seconds())} seconds")
    fresh = ~follows | F.col("_ended") | F.coalesce(idle, F.lit(False))
    name = F.coalesce(F.concat(F.lit("="), F.col(identity).cast("string")), F.lit(""))
    placed = reliable(near.select(*rows.columns, "_control", F.col("rank").alias("place"), name.alias("name"), follows.alias("follows"), fresh.alias("fresh")))
    starts = _session_starts(placed.where("not _control"), CAP).withColumn("_opens", F.lit(True))
    return placed.join(starts, "place", "left").withColumn("opens", F.coalesce("_opens", F.lit(False))).drop("_opens", "fresh")


def _from_first(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with ``number`` counted from 1 in each key; numbers grow with the keys' own order."""
    named = rows.withColumn("_k", F.to_json(F.struct(key)))  # a null key is one, too
    firsts = named.groupBy("_k").agg(F.min(number).alias("_least"))
    return hot_join(named, firsts, "_k").withColumn(number, F.col(number) - F.col("_least") + 1).drop("_k", "_least")


def capped_sessions(events: DataFrame, key: str, identity: str) -> DataFrame:
    """key, seq, session: sessions end after 30 idle minutes, and once 20 distinct identities are in; numbered by key from 1.

    Neither a key's log nor a stretch of activity has to fit in a task (see ``_session_starts``).
    """
    opened = _opened(events.select(key, "seq", "ts", identity), key, identity, ["ts", "seq"], F.lit(False))
    numbered = reliable(with_running_sum(opened, ["place"], F.col("opens").cast("long"), "session"))
    return _from_first(numbered, key, "session").select(key, "seq", "session")


def debounced(events: DataFrame, key: str, delay_seconds: float) -> DataFrame:
    """Events that a trailing-edge debounce lets through: no later event of the key within the delay."""
    following = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "seq"))
    quiet = following.isNull() | (following - F.col("ts") >= F.expr(f"interval {int(delay_seconds * 1000)} milliseconds"))
    return events.where(F.lit(True)).withColumn("_fires", quiet).where("_fires").drop("_fires")


def changed_signatures(events: DataFrame, key: str, signature: str, baseline: DataFrame) -> DataFrame:
    """Observations whose signature differs from the key's previous one, or from the baseline at first."""
    previous = F.coalesce(F.lag(signature).over(_by(key)), F.col("base_signature"))
    rows = events.join(baseline.select(key, F.col(signature).alias("base_signature")), key, "left")
    return rows.withColumn("_same", F.col(signature).eqNullSafe(previous)).where("not _same").drop("_same", "base_signature")


def watched_sessions(events: DataFrame, controls: DataFrame, key: str, identity: str) -> DataFrame:
    """key, seq, session, sealed_by of a watched log: sessions as of ``capped_sessions``, cut also by control events.

    ``controls`` has key, ts and kind. A commit or a manual seal ends the open session after the events up to its time; a
    branch switch discards the open session's events. One that comes when the idle time is over finds no open session. Sessions are numbered by key as they end; the last may be ``open``.
    ``sealed_by`` is cap, idle, git, manual or open.
    """
    marks = controls.where(F.col("kind").isin("commit", "manual", "branch-switch")).select(key, "ts", F.lit(None).cast("long").alias("seq"), F.lit(None).cast(events.schema[identity].dataType).alias(identity), "kind")
    every = events.select(key, "ts", "seq", identity, F.lit(None).cast("string").alias("kind")).unionByName(marks).withColumn("_later", F.col("kind").isNotNull())
    opened = _opened(every, key, identity, ["ts", "_later", "seq"], F.col("_later"))
    numbered = reliable(with_running_sum(opened, ["place"], F.col("opens").cast("long"), "own"))
    inside = numbered.where("not _control")
    ends = inside.groupBy("own").agg(F.max_by(F.col(key), "place").alias("_key"), (F.max("place") + 1).alias("place"), F.max("ts").alias("last"), F.size(F.collect_set("name")).alias("size"))  # CAP names at most
    behind = numbered.select("place", F.col("kind").alias("end"), F.col("ts").alias("next"), "follows")
    waited = F.col("next") - F.col("last") >= F.expr(f"interval {int(IDLE.total_seconds())} seconds")
    by = F.when(F.col("size") >= CAP, "cap").when(~F.coalesce("follows", F.lit(False)), "open").when(waited, "idle").when(F.col("end") == "commit", "git").when(F.col("end").isNotNull(), F.col("end")).otherwise("idle")
    sessions = reliable(ends.join(behind, "place", "left").select("own", F.col("_key").alias(key), by.alias("sealed_by")).where("sealed_by <> 'branch-switch'"))
    counted = _from_first(with_rank(sessions, ["own"]), key, "rank").select("own", F.col("rank").cast("int").alias("session"), "sealed_by")
    return inside.join(counted, "own").select(key, "seq", "session", "sealed_by")


def removed_files(removals: DataFrame, baseline: DataFrame, last_seen: DataFrame, history: DataFrame) -> DataFrame:
    """identity, type of the declarations that go with removed files, as the log has not recorded them yet.

    The baseline's declarations of a file are compared with nothing, unless the file was last seen empty already. What the
    history has as deleted is not recorded again. ``removals`` has file, ``baseline`` file and identity, ``last_seen`` file and
    n (declarations), ``history`` identity and type.
    """
    empty = last_seen.where("n = 0").select("file")
    gone = baseline.join(removals.select("file").distinct(), "file").join(empty, "file", "left_anti")
    return new_changes(gone.select("identity", F.lit("deleted").alias("type")), history)


def routed(feed: DataFrame, delay_seconds: float) -> DataFrame:
    """The file events that are acted on: removals at once, additions and changes once quiet for the delay; a removal cancels what waits.

    ``feed`` has file, ts, seq, op (add, change, unlink).
    """
    saves = feed.withColumn("_waits", F.col("op") != "unlink")
    following = F.lead("ts").over(Window.partitionBy("file").orderBy("ts", "seq"))
    quiet = following.isNull() | (following - F.col("ts") >= F.expr(f"interval {int(delay_seconds * 1000)} milliseconds"))
    return saves.withColumn("_fires", ~F.col("_waits") | quiet).where("_fires").drop("_fires", "_waits")


def file_changes(feed: DataFrame, baseline: DataFrame, delay_seconds: float) -> DataFrame:
    """file, seq, ts, identity, type of the changes that a feed of file events makes.

    ``feed`` has file, ts, seq, op and facts (identity to signature, a map), ``baseline`` file and facts. A save that counts
    (``routed``) is compared with the declarations that were seen before it, at first with the baseline; a removal with the
    baseline, whose declarations it deletes, if there are any. A signature equal to the one before changes nothing, and what
    was seen before a removal stays what a later save is compared with.
    """
    none = F.create_map().cast("map<string,string>")
    based = routed(feed, delay_seconds).join(baseline.select("file", F.col("facts").alias("_base")), "file", "left").withColumn("_base", F.coalesce("_base", none))
    gone = F.col("op") == "unlink"
    known = based.where(~gone | (F.size("_base") > 0)).withColumn("facts", F.when(gone, none).otherwise(F.coalesce("facts", none)))
    told = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("facts"))))
    order = Window.partitionBy("file").orderBy("ts", "seq")
    marked = known.withColumn("_told", told).withColumn("_counts", ~F.col("_told").eqNullSafe(F.lag("_told").over(order)))
    seen = F.last(F.when(F.col("_counts") & ~gone, F.col("facts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    old = F.when(gone, F.col("_base")).otherwise(F.coalesce("_seen", "_base"))
    both = marked.withColumn("_seen", seen).where("_counts").select("file", "seq", "ts", old.alias("a"), F.col("facts").alias("b"))
    each = both.select("*", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("identity"))
    was, now = F.try_element_at("a", F.col("identity")), F.try_element_at("b", F.col("identity"))
    kind = F.when(was.isNull(), "added").when(now.isNull(), "deleted").when(was != now, "changed")
    return each.select("file", "seq", "ts", "identity", kind.alias("type")).where("type is not null")


def one_shot(entries: DataFrame, sealed: DataFrame, session: str, reason: str) -> DataFrame:
    """The events that record a one-shot session: a start marker, its entries, a seal marker; none if an earlier one is identical.

    ``entries`` and ``sealed`` (with session and reason) have entry as text; ``entries`` also seq.
    """
    from .planning import identical_sessions

    now = entries.select(F.lit("~").alias("session"), F.lit(reason).alias("reason"), "entry")
    repeated = not identical_sessions(sealed.select("session", "reason", "entry").unionByName(now)).where("session = '~'").isEmpty()
    if repeated or entries.isEmpty():
        return entries.sparkSession.createDataFrame([], "place int, seq long, type string, entry string, session string")
    marks = entries.sparkSession.createDataFrame([(0, None, "session_started", None, session), (2, None, "session_sealed", None, session)], "place int, seq long, type string, entry string, session string")
    return marks.unionByName(entries.select(F.lit(1).alias("place"), F.col("seq").cast("long"), F.lit("change").alias("type"), "entry", F.lit(session).alias("session"))).orderBy("place", "seq")


def distinct_identities(events: DataFrame, key: str) -> DataFrame:
    """key, n: the identities that a session's events name."""
    return events.groupBy(key).agg(F.count_distinct("identity").alias("n"))


def recovered_net_delta(events: DataFrame, keys: list[str]) -> DataFrame:
    """``net_delta`` of a log that is read again: changed events only, and only whole pairs (``before`` and ``after`` known to be there)."""
    return net_delta(events.where("type = 'changed' and pair"), keys)


def with_running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows up to this one in a global order, without a single-task window."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = reliable(df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))  # one row a partition
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_value")


def time_groups_of_all(events: DataFrame, gap_minutes: int) -> DataFrame:
    """``events`` with ``grp`` over the whole log: a new group when ``gap_minutes`` or more have passed since the event before.

    The event before is found by its place in the log, so no task sees all events.
    """
    ranked = reliable(with_rank(events, ["ts", "seq"]))
    previous = ranked.select((F.col("rank") + 1).alias("rank"), F.col("ts").alias("_previous"))
    flagged = ranked.join(previous, "rank", "left")
    fresh = F.coalesce((F.col("ts") - F.col("_previous") >= F.expr(f"interval {gap_minutes} minutes")).cast("long"), F.lit(1))
    return with_running_sum(flagged, ["rank"], fresh, "grp").select(*events.columns, "grp")


def new_or_unfinished(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events that the history lacks by (ts, type, identity), or holds without a finished label (``finished`` of the stored row)."""
    done = stored.where("finished").select("ts", "type", "identity").distinct()
    return events.join(done, ["ts", "type", "identity"], "left_anti")


def recovered_sessions(log: DataFrame, key: str) -> DataFrame:
    """key, session, events, sealed of a log's sessions: from one start marker to the next; events before the first are left out.

    A session is sealed if a seal marker follows its start; without one it is open still.
    """
    marked = log.withColumn("session", F.sum((F.col("type") == "session_started").cast("int")).over(_by(key).rowsBetween(Window.unboundedPreceding, 0)))
    plain = ~F.col("type").isin("session_started", "session_sealed")
    return marked.where("session > 0").groupBy(key, "session").agg(F.count_if(plain).alias("events"), F.bool_or(F.col("type") == "session_sealed").alias("sealed"))


def seal(events: DataFrame, entries: DataFrame, session: str = "session") -> DataFrame:
    """session, opened_at, sealed_at, events, entries, significant of sessions that have events; ``entries`` has significant."""
    own = events.groupBy(session).agg(F.min("ts").alias("opened_at"), F.max("ts").alias("sealed_at"), F.count("*").alias("events"))
    kept = entries.groupBy(session).agg(F.count("*").alias("entries"), F.bool_or("significant").alias("significant"))
    return own.join(kept, session, "left").fillna(0, ["entries"]).withColumn("significant", F.coalesce("significant", F.lit(False)))
