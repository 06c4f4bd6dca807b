import datetime as dt
import hashlib
import random

import duckdb

from factloom.llm import components, quotes, urls
from factloom.llm.oracles import QUOTES


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(r.randint(1, 9)):
            lines = [f"Some line {r.randrange(40)} of  the Talk {r.randrange(5)}" for _ in range(r.randint(1, 3))]
            if said and r.random() < 0.7:
                old = r.choice(said)
                part = r.choice([old, old.split("\n")[0], old.upper().replace(" ", "  ")])
                quoted = [f"{r.choice(['>', '> ', ' >'])}{x}" for x in part.split("\n")]
                if r.random() < 0.3:
                    quoted = ["> > " + x for x in r.choice(said).split("\n")] + quoted
                lines = r.choice([quoted + lines, lines + quoted, quoted, [*quoted, "", *lines, *quoted]])
            text = "\n".join(lines)
            said.append("\n".join(x for x in lines if not x.lstrip().startswith(">")) or text)
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
    return rows


def test_links_equal_sql(spark):
    for seed in (1, 2, 3):
        rows = conversations(seed)
        got = {tuple(x) for x in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
        con = duckdb.connect()
        con.execute("create table messages (conv_id bigint, turn bigint, role varchar, text varchar)")
        con.executemany("insert into messages values (?, ?, ?, ?)", rows)
        assert got == set(con.execute("WITH RECURSIVE" + QUOTES).fetchall())
        assert sum(x[6] is not None for x in got) > 5


def test_nested_and_odd_messages(spark):
    rows = [
        (1, 0, "u", "First thing said here"), (1, 1, "a", "> first  THING said here\nsecond"), (1, 2, "u", ">> First thing said here\n> second\nthird"), (1, 2, "u", "repeat of a turn"),
        (1, 3, "a", "no quote"), (1, 4, "a", ">"), (2, 0, "u", None), (2, 1, "u", ""), (2, 2, "u", "> First thing said here"), (None, 5, "u", "> x"), (3, None, "u", "> x"), (4, 0, "u", "x\n" * 30000 + "> y\n" * 30000),
    ]
    clashing = ["n_quotes", "c", "root", "up", "own_text", "passages_of", "parts_of_text", "part_of", "link_conv", "_own", "_c"]
    table = spark.createDataFrame([(*r, *["x"] * len(clashing)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in clashing))
    out = quotes.link_quotes(table)
    assert all({x[c] for x in out.select(c).collect()} == {"x"} for c in clashing[1:])
    got = {(x["conv_id"], x["turn"]): x for x in out.collect() if x["text"] != "repeat of a turn"}
    assert out.count() == len(rows)
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, 1, None, None] and got[1, 2]["thread_root"] == 0
    assert got[1, 2]["text"] == "third" and got[1, 2]["quote_depth"] == 2 and got[1, 2]["n_quotes"] == 2
    assert got[2, 0]["text"] is None and got[2, 1]["text"] == "" and got[2, 2]["reply_to"] is None and got[2, 2]["text"] == ""
    assert got[4, 0]["n_quotes"] == 1
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    places = {}
    for x in out.collect():
        places.setdefault(x["conv_id"], []).append(x["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for c, p in places.items() if c is not None) and places[None] == [None]


def test_conversations_in_reply_order(spark):
    rows = [(7, i, "u", f"Message number {i} is said here") for i in range(2500)] + [(7, 2500, "a", "> message number 3 is said here\nYes"), (8, 0, "u", "Alone")]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(x["conv_id"], x["piece"]): x["messages"] for x in quotes.conversations(linked).collect()}
    assert [len(got[7, k]) for k in range(3)] == [1000, 1000, 501] and len(got[8, 0]) == 1
    assert (got[7, 0][4]["text"], got[7, 0][4]["reply_to"], got[7, 0][5]["text"]) == ("Yes", 3, "Message number 4 is said here")


def test_hot_hosts_and_conversations(spark, monkeypatch):
    """The same results where every host, suffix and conversation of more than one row counts as heavy."""
    monkeypatch.setattr(components, "HEAVY", 1)
    monkeypatch.setattr(components, "HEAVY_KEYS", 1 << 40)
    day = dt.date
    listed = spark.createDataFrame([("com", "block", day(2024, 1, 1)), ("ok.a.com", "allow", day(2024, 1, 2)), ("b.org/x", "block", day(2024, 1, 1)), ("none.net", "block", day(2024, 1, 1))], "pattern string, verdict string, since date")
    urls_of = [("http://a.com/1", "block"), ("http://a.com/1", "block"), ("http://ok.a.com/2", "allow"), ("http://b.org/x?q", "block"), ("http://b.org/x", "block"), ("http://b.org/y", "none"), ("http://c.org", "none"), (None, "none")]
    table = spark.createDataFrame([(u, day(2024, 1, 3), v) for u, v in urls_of], "url string, fetched_on date, expected string")
    got = urls.filter_captures(table, listed).collect()
    assert len(got) == len(urls_of) and all(x["verdict"] == x["expected"] for x in got)
    rows = conversations(4)
    con = duckdb.connect()
    con.execute("create table messages (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into messages values (?, ?, ?, ?)", rows)
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {tuple(x) for x in linked.collect()} == set(con.execute("WITH RECURSIVE" + QUOTES).fetchall())


def test_as_of_verdicts(spark):
    day = dt.date
    entries = [
        ("bad.com", "block", day(2024, 1, 10)), ("bad.com", "removed", day(2024, 2, 1)), ("ok.bad.com", "allow", day(2024, 1, 15)), ("tie.com", "allow", day(2024, 1, 1)), ("tie.com", "block", day(2024, 1, 1)),
        ("site.org/x", "block", day(2024, 1, 1)), (None, "block", day(2024, 1, 1)), ("null.com", None, day(2024, 1, 1)), ("null.com", "block", None),
    ]
    captures = [
        (1, "http://bad.com/a", day(2024, 1, 9), "none"), (2, "HTTPS://WWW.Bad.com:80/a?q", day(2024, 1, 10), "block"), (3, "http://bad.com", day(2024, 2, 1), "none"), (4, "http://ok.bad.com/", day(2024, 1, 20), "allow"),
        (5, "http://u:p@ok.bad.com./", day(2024, 1, 14), "block"), (6, "http://notbad.com/", day(2024, 1, 20), "none"), (7, "http://tie.com", day(2024, 1, 1), "block"), (8, "http://site.org/x?y#z", day(2024, 5, 1), "block"),
        (9, "http://site.org/xy", day(2024, 5, 1), "none"), (10, None, day(2024, 1, 1), "none"), (11, "", day(2024, 1, 1), "none"), (12, "junk", day(2024, 1, 1), "none"), (13, "http://bad.com", None, "none"), (None, "http://bad.com/a", day(2024, 1, 11), "block"),
        (2, "HTTPS://WWW.Bad.com:80/a?q", day(2024, 1, 10), "block"), (14, "http://" + "a." * 50000 + "bad.com/", day(2024, 1, 11), "none"), (15, "http://null.com", day(2024, 3, 1), "none"),
    ]
    clashing = ["pattern", "page_key", "page_spans", "_url", "_at", "page", "c", "spans"]
    table = spark.createDataFrame([(*c, *["clash"] * len(clashing)) for c in captures], "page_id long, url string, fetched_on date, expected string, " + ", ".join(f"{c} string" for c in clashing))
    listed = spark.createDataFrame(entries, "pattern string, verdict string, since date")
    out = urls.filter_captures(table, listed)
    assert out.count() == len(captures)
    assert all(x["verdict"] == x["expected"] for x in out.collect())
    assert all({x[c] for x in out.select(c).collect()} == {"clash"} for c in clashing[1:])
    assert {x["verdict"] for x in urls.filter_captures(table, listed.limit(0)).collect()} == {"none"}
    assert urls.filter_captures(table.limit(0), listed).count() == 0


def test_conversations_against_a_plain_loop(spark, monkeypatch):
    """Pieces of three: threads in order of their first message, then turns, then texts' digests; rows without a conversation left out."""
    monkeypatch.setattr(quotes, "PIECE", 3)
    said = [f"message number {k} says something of its own" for k in range(9)]
    rows = [("c", k, "user", said[k]) for k in range(5)] + [("c", 5, "bot", f"> {said[1]}\nyes"), ("c", 6, "bot", f"> {said[0]}\nno"), ("c", 7, None, "> yes\nand more"), ("c", 6, "bot", f"> {said[0]}\nno")]
    rows += [("d", 0, "user", None), ("d", 1, "user", ""), (None, 0, "user", said[8])]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).cache()
    got = {(r["conv_id"], r["piece"]): [tuple(m) for m in r["messages"]] for r in quotes.conversations(linked).collect()}
    want = {}
    by_digest = lambda r: (r["thread_root"], r["turn"], hashlib.md5((r["text"] or "").encode()).hexdigest())
    for conv in ("c", "d"):
        ordered = sorted((r for r in linked.collect() if r["conv_id"] == conv), key=by_digest)
        for at, r in enumerate(ordered):
            want.setdefault((conv, at // 3), []).append((r["role"], r["text"], r["reply_to"]))
    assert got == want and len(got["c", 0]) == 3 and sum(map(len, got.values())) == 11
    assert {r["turn"]: r["reply_to"] for r in linked.where("conv_id = 'c' and turn > 4").collect()} == {5: 1, 6: 0, 7: 5}
