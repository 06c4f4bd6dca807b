"""URL filtering by a temporal list join.

Dated list entries become validity intervals (an entry holds until the pattern's next one), and an as-of join evaluates every
capture against the entries active when it was fetched. Pages are joined by the suffixes of their host and by host and path,
so the join is an equality on the pattern; the date then picks among the pattern's intervals, and the most specific active
pattern decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, fresh
from .components import heavy_join

#: Longer hosts are not host names; they match no pattern.
HOST_CHARS = 253
#: Verdicts by strength: of several for one pattern and date the strongest counts; REMOVED ends an entry.
BLOCK, ALLOW, REMOVED = "block", "allow", "removed"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if there is none."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(F.length(host) <= HOST_CHARS, host).otherwise(F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, verdict, since, until (exclusive, null: open) from dated entries (pattern, verdict, since)."""
    strength = F.when(F.col("verdict") == BLOCK, 2).when(F.col("verdict") == ALLOW, 1).otherwise(0)
    one = entries.where("pattern is not null and since is not null and verdict is not null").groupBy("pattern", "since").agg(F.max_by("verdict", strength).alias("verdict"))
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.withColumn("until", following).where(F.col("verdict") != REMOVED)


def _known_suffixes(hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """host, pattern: which of a host's suffixes at label borders are patterns.

    Every host has its last label's suffix, so the suffixes are counted first: those of very many hosts (HEAVY_KEYS at most) are
    looked up where the hosts are, and dropped there if they are no pattern.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(suffixes).alias("pattern"))
    counted = each.groupBy("pattern").agg(F.count("*").alias("c"))
    counted = checkpointed(counted.join(patterns.withColumn("known", F.lit(True)), "pattern", "left"))
    return heavy_join(each, counted, "pattern").where("known").select("host", "pattern")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``host``, ``verdict`` (block, allow or none), ``pattern`` and ``since`` of the entry that decides.

    Patterns are host suffixes at label borders, or host and path without query. The longest active pattern wins, ties go to
    the later date. A null or malformed url and a null date match nothing; repeated rows are judged alike; without entries
    every verdict is none; an empty table stays empty. Columns of the added names are replaced, all others stay.

    A pattern's intervals are one list (a list's dates are few); every distinct page gets the lists that concern it, and a
    capture picks what was active at its date. Hosts and pages of very many rows are looked up where the rows are.
    """
    captures = captures.drop("host", "verdict", "pattern", "since")
    page, spans = fresh(captures.withColumn("host", F.lit("")), "page_key", "page_spans")
    own = [col(c) for c in captures.columns]
    url, fetched = col(url_col), col(fetched_col)
    path = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    hosts = captures.select(*own, F.coalesce(host_of(url), F.lit("")).alias("host"))
    asked = hosts.where((F.col("host") != "") & fetched.isNotNull()).select(*own, "host", F.concat("host", F.when(F.length(path) > 1, path).otherwise(F.lit(""))).alias(page))
    rest = hosts.where((F.col("host") == "") | fetched.isNull())

    lists = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("since", "until", "verdict")).alias("spans"))
    lists = checkpointed(lists.select("pattern", F.transform("spans", lambda s: F.struct(s["since"].alias("since"), s["until"].alias("until"), s["verdict"].alias("verdict"), F.col("pattern").alias("pattern"))).alias("spans")))
    pages = checkpointed(asked.groupBy("host", F.col(page).alias("page")).agg(F.count("*").alias("c")))
    known = _known_suffixes(pages.select("host").distinct(), lists.select("pattern")).join(lists, "pattern")
    per_host = known.groupBy("host").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a host has few suffixes
    per_host = checkpointed(per_host.join(pages.groupBy("host").agg(F.count("*").alias("c")), "host"))
    by_host = heavy_join(pages.select("host", "page"), per_host, "host").select("page", "spans")
    by_path = pages.where("page <> host").select("page").join(lists.select(F.col("pattern").alias("page"), "spans"), "page")
    none = F.array().cast(lists.schema["spans"].dataType)
    found = by_host.unionByName(by_path).groupBy("page").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    table = checkpointed(pages.select(F.col("page").alias(page), "c").join(found.withColumnsRenamed({"page": page, "spans": spans}), page, "left").withColumn(spans, F.coalesce(spans, none)))

    active = F.filter(spans, lambda s: (s["since"] <= fetched) & (s["until"].isNull() | (fetched < s["until"])))
    rank = F.transform(active, lambda s: F.struct(F.length(s["pattern"]).alias("n"), s["since"].alias("since"), s["pattern"].alias("pattern"), s["verdict"].alias("verdict")))
    best = F.array_max(rank)
    judged = heavy_join(asked, table, page).select(*own, "host", best.alias(spans))
    judged = judged.select(*own, "host", F.coalesce(F.col(spans)["verdict"], F.lit("none")).alias("verdict"), F.col(spans)["pattern"].alias("pattern"), F.col(spans)["since"].alias("since"))
    empty = [F.lit("none").alias("verdict"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast(entries.schema["since"].dataType).alias("since")]
    return judged.unionByName(rest.select(*own, "host", *empty))
