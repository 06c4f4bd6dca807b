import datetime as dt
import random

from factloom.llm import decontaminate as d


def smith_waterman(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (d.MATCH if x == y else d.MISMATCH), table[i - 1][j] + d.GAP, table[i][j - 1] + d.GAP)
            best = max(best, table[i][j])
    return best


def test_scores_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [[r.choice(words) for _ in range(r.randint(15, 45))] for _ in range(12)] + [["only", "Two"]]
    rows, texts = [], []
    for n in range(80):
        text = [r.choice(words) for _ in range(r.randint(0, 150))]
        item = list(r.choice(items))
        if n % 2:
            for _ in range(n % 8):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice([[], ["new"], [item[k], "new"]]) or [item[k]]
            at = r.randint(0, len(text))
            text[at:at] = item[: max(3, len(item) - n % 5)]
        texts.append(text)
        rows.append((n, " \n".join(text).upper() if n % 3 else " ".join(text), "s", 0.5))
    rows += [(1, rows[1][1], "s", 1.0), (200, None, "s", None), (201, "", None, None), (202, "x " * 60000, None, None), (None, " ".join(items[0]), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, " "), (None, "a b c d")], "item_id long, text string")
    got = {}
    for x in d.find_contamination(docs, bench).collect():
        got[x["doc_id"], x["item_id"]] = x["score"]
    expected = {}
    for n, text in enumerate(texts):
        for i, item in enumerate(items):
            score = smith_waterman([w.lower() for w in item], [w.lower() for w in text]) / (d.MATCH * len(item))
            if score >= d.THRESHOLD:
                expected[n, i] = score
    missed = {k for k in set(expected) - set(got) if len(items[k[1]]) > d.SEED}  # shorter items are found verbatim only
    assert all(expected[x] < 0.6 for x in missed) and len(missed) <= len(expected) // 20
    assert {k: round(v, 9) for k, v in got.items() if k[0] is not None} == {k: round(v, 9) for k, v in expected.items() if k in got}
    assert (None, 0) in got
    kept = {x["doc_id"] for x in d.drop_contaminated(docs, bench).collect()}
    assert kept == {x[0] for x in rows} - {k[0] for k in got}
    assert d.drop_contaminated(docs, bench).columns == docs.columns


def test_empty_tables_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")], "item_id long, text string")
    assert d.find_contamination(docs.limit(0), bench).count() == 0
    assert d.find_contamination(docs, bench.limit(0)).count() == 0 and d.drop_contaminated(docs, bench.limit(0)).count() == 2
    monkeypatch.setattr(d, "BLOCK_BYTES", 12)
    assert {(x[0], x[1]) for x in d.find_contamination(docs, bench).collect()} == {(1, 1), (2, 2), (2, 3)}
    assert d.drop_contaminated(docs, bench).count() == 0


def test_every_pair_at_the_threshold_is_found(spark):
    r = random.Random(11)
    common = [f"w{i}" for i in range(60)]
    items = [[f"i{n}x{k}" if k % 4 else r.choice(common) for k in range(size)] for n, size in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 31])]
    third = lambda item: ["new" if k % 3 == 2 else w for k, w in enumerate(item)]
    spread = lambda item: [x for w in item for x in (w, "new")][:-1]
    half = lambda item: item[: -(-len(item) // 2)]
    shorter = lambda item: [w for k, w in enumerate(item) if k % 3]
    texts = [" ".join(["start", *edit(item), "stop"]) for item in items for edit in (third, spread, half, shorter)]
    texts += [" ".join(r.choice([*common, *items[r.randrange(12)]]) for _ in range(r.randint(1, 80))) for _ in range(60)]
    texts += [" ".join([*(r.choice(common) for _ in range(200)), *spread(items[11]), *(r.choice(common) for _ in range(200)), *third(items[11])])]
    # An item that leaked into most documents has only common seeds.
    texts += [" ".join(items[10]) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    scores = {(n, i): smith_waterman(item, text.split()) / (d.MATCH * len(item)) for n, text in enumerate(texts) for i, item in enumerate(items)}
    expected = {k: round(v, 9) for k, v in scores.items() if v >= d.THRESHOLD}
    got = d.find_contamination(docs, bench).collect()
    assert len(got) == len(expected) and {(x["doc_id"], x["item_id"]): round(x["score"], 9) for x in got} == expected
    assert min(expected.values()) == d.THRESHOLD and any(x["seed_hits"] == 0 for x in got)
    assert {x["doc_id"] for x in d.drop_contaminated(docs, bench).collect()} == set(range(len(texts))) - {n for n, _ in expected}


def test_item_ids_of_any_type(spark):
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"some words {text} and more")], "doc_id long, text string")
    for kind, value in (("date", dt.date(2024, 1, 2)), ("double", 1.5), ("string", "x"), ("short", 3), ("boolean", True)):
        assert [x["item_id"] for x in d.find_contamination(docs, spark.createDataFrame([(value, text)], f"item_id {kind}, text string")).collect()] == [value]


def test_one_very_long_item_among_many_short_ones():
    items = [f"short item number {i} of many" for i in range(20_000)] + [" ".join(f"w{i}" for i in range(200_000))]
    paired, _ = d.Block.of(list(range(len(items))), items)
    counted = paired.with_counts({0: 5, 1: 7})
    assert len(counted.words) == len(items) and 0 < len(counted.keys) <= len(paired.keys)
