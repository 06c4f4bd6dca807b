"""Chat formatting by quotation linking, in DataFrame expressions only.

A message's lines carry nested quote levels (leading ``>`` marks). Maximal runs of one level are passages; their normalised
text is hashed, whole and by line, and joined to the earliest earlier message of the conversation that says it. The outermost
linked passage tells what a message replies to. Quotes are taken out, and messages get their place in reply order: by the
thread's first message, then by turn; conversations are put together in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, fresh, let, partitions
from .components import heavy_join

_MARKS = r"^(?:[\x20\t]*>)+"
#: A single quoted line links only from this many characters on; whole passages always may.
LINE_CHARS = 20


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\t\r\n]+", " "))


def quote_parts(messages: DataFrame, text_col: str, own_col: str, passages_col: str) -> DataFrame:
    """``messages`` with ``own_col`` (text without quotes) and ``passages_col`` (array of level and text, in order)."""
    body = lambda x: F.regexp_replace(x, _MARKS + r"[\x20\t]?", "")

    def parts(lines: Column, levels: Column) -> Column:
        level = lambda i: F.coalesce(F.get(levels, i), F.lit(-1))
        each = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(each, lambda i: (level(i) > 0) & (level(i - 1) != level(i)))
        ends = F.filter(each, lambda i: (level(i) > 0) & (level(i + 1) != level(i)))
        passage = lambda s, e: F.struct(level(s).alias("level"), F.array_join(F.transform(F.slice(lines, s + 1, e - s + 1), body), "\n").alias("text"))
        own = F.array_join(F.filter(lines, lambda x, i: level(i) == 0), "\n")
        return F.struct(own.alias("own"), F.zip_with(starts, ends, passage).alias("passages"))

    levels = lambda lines: F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")))
    text, every, (name,) = col(text_col), [col(c) for c in messages.columns], fresh(messages, "parts_of_text")
    quoted = text.rlike("(?m)" + _MARKS)
    # Both arrays are bound once per message: every step below is linear in the number of lines.
    split = let(F.split(text, "\n", -1), lambda lines: let(levels(lines), lambda found: parts(lines, found)))
    out = messages.select(*every, F.when(quoted, split).alias(name))
    none = F.array().cast("array<struct<level:int,text:string>>")
    own = F.when(F.col(name).isNotNull(), F.trim(F.col(name)["own"])).otherwise(text)
    return out.select(*every, own.alias(own_col), F.coalesce(F.col(name)["passages"], none).alias(passages_col))


def _units(text: Column) -> Column:
    """What a text can be recognised by: itself (weight 1000) and its longer lines, normalised and hashed."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), _normal), lambda x: F.length(x) >= LINE_CHARS)

    def of(whole: Column) -> Column:
        every = F.array_union(F.filter(F.array(whole), lambda x: F.length(x) > 0), lines)
        return F.transform(every, lambda x: F.struct(F.md5(x.cast("binary")).alias("unit"), F.when(x == whole, 1000).otherwise(1).alias("weight")))

    return let(_normal(text), of)  # normalised once; the union keeps every unit once


ADDED = ("n_quotes", "quote_depth", "reply_to", "thread_root", "place")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with text without quotes, ``n_quotes``, ``quote_depth``, ``reply_to``, ``thread_root`` and ``place``.

    reply_to is the turn that the message's outermost (then first) linked passage quotes, null without one; thread_root is
    the turn at the end of that chain, the message's own without a link. place (from 1) is the message's place in its
    conversation in reply order: by thread_root, then turn, then the text's digest. A passage goes to the message with most in
    common, ties to the earliest. Rows with a null conversation or turn link to nothing, and without a conversation have no
    place; a null text stays null and an empty one empty; rows that repeat a turn link alike, by the least link among
    them. An empty table stays empty. Columns of the added names are replaced, all others stay.
    """
    messages = messages.drop(*ADDED)
    own, quoted, up, root = fresh(messages, "own_text", "passages_of", "reply_turn", "root_turn")
    parts = quote_parts(messages, text_col, own, quoted)
    keyed = parts.where(col(conv).isNotNull() & col(turn).isNotNull()).select(col(conv).alias("c"), col(turn).alias("t"), F.col(own).alias("own"), F.col(quoted).alias("passages"))
    passages = keyed.where(F.size("passages") > 0).select("c", "t", F.posexplode("passages").alias("k", "p"))
    asked = passages.select("c", "t", "k", "p.level", F.explode(_units(F.col("p.text"))).alias("u")).select("c", "t", "k", "level", "u.unit", "u.weight")
    # Only conversations with quotes are looked up, by hash, and of a unit only the earliest message that says it is kept.
    quoting = keyed.groupBy(F.col("c").alias("conv")).agg(F.count("*").alias("c"), F.max(F.size("passages")).alias("most")).where("most > 0").drop("most")
    said = heavy_join(keyed.select(F.col("c").alias("conv"), "t", "own"), checkpointed(quoting), "conv").withColumnRenamed("conv", "c")
    said = said.select("c", "t", F.explode(_units(F.col("own"))).alias("u")).groupBy("c", "u.unit").agg(F.min("t").alias("from"))
    hits = asked.join(said, ["c", "unit"]).where(F.col("from") < F.col("t")).groupBy("c", "t", "k", "level", "from").agg(F.sum("weight").alias("weight"))
    best = hits.groupBy("c", "t", "k", "level").agg(F.max_by("from", F.struct("weight", -F.col("from"))).alias("from"))
    links = checkpointed(best.groupBy("c", "t").agg(F.min_by("from", F.struct("level", "k", "from")).alias("up")))
    # Pointer jumping: each round doubles the part of the chain that is known.
    reach = links.select("c", "t", "up", F.col("up").alias("root"))
    while True:
        on = reach.select("c", F.col("t").alias("root"), F.col("root").alias("next"))
        further = checkpointed(reach.join(on, ["c", "root"], "left").select("c", "t", "up", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not further.where("moved").isEmpty()
        reach = further.drop("moved")
        if not moved:
            break
    here, at = fresh(parts, "link_conv", "link_turn")
    out = parts.join(reach.toDF(here, at, up, root), (col(conv) == F.col(here)) & (col(turn) == F.col(at)), "left")
    depth = F.coalesce(F.array_max(F.transform(quoted, lambda p: p["level"])), F.lit(0))
    columns = [F.col(own).alias(c) if c == text_col else col(c) for c in messages.columns]
    out = out.select(*columns, F.greatest(F.size(quoted), F.lit(0)).alias("n_quotes"), depth.alias("quote_depth"), F.col(up).alias("reply_to"), F.coalesce(F.col(root), col(turn)).alias("thread_root"))
    return _placed(out, conv, [col(conv), F.col("thread_root"), col(turn), F.md5(col(text_col).cast("binary"))])


def _placed(rows: DataFrame, conv: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, their place in the conversation, without gathering one.

    Rows are range-partitioned in order; only conversations that lie across a border between partitions, so no more than
    there are partitions, need to know how many of their rows lie before.
    """
    part, before, key = fresh(rows, "part_of", "rows_before", "key_of")
    dealt = checkpointed(rows.repartitionByRange(partitions(rows), *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(F.col(part), col(conv).alias(key)).agg(F.count("*").alias("n"))
    split = counts.groupBy(key).agg(F.count("*").alias("parts")).where("parts > 1").select(key)
    earlier = F.sum("n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.join(split, key).select(F.col(key), F.col(part).alias("shift_part"), F.coalesce(earlier, F.lit(0)).alias(before))
    out = dealt.join(F.broadcast(shift), (F.col(part) == F.col("shift_part")) & (col(conv) == F.col(key)), "left")
    inside = F.row_number().over(Window.partitionBy(F.col(part), col(conv)).orderBy(*order[1:]))
    place = F.when(col(conv).isNotNull(), inside + F.coalesce(F.col(before), F.lit(0)))
    return out.select(*[col(c) for c in rows.columns], place.cast("long").alias("place"))


#: Messages of a piece of a conversation.
PIECE = 1000


def conversations(linked: DataFrame, conv: str = "conv_id", role: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, piece (from 0), messages: what ``link_quotes`` returned, as arrays of (role, text, reply_to) in reply order.

    A conversation of more than PIECE messages comes in several pieces, so no row holds more. Rows without a conversation
    belong to none.
    """
    message = F.struct("place", col(role).alias("role"), col(text_col).alias("text"), "reply_to")
    rows = linked.where(F.col("place").isNotNull()).groupBy(col(conv).alias(conv), F.expr(f"cast((place - 1) div {PIECE} as int)").alias("piece")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return rows.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"), m["reply_to"].alias("reply_to"))))
