"""Small tables with nulls, ties, repeated rows, odd texts and clashing columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, pii, sharding, topk

LONG = "word " * 20000 + "a" * 30000
TEXTS = [
    None, "", " ", "x", "Mail a.b@c.d_e@f.gh now", "a@b.c@d.e", "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 and 999.1.1.1", "call +1 (578) 555-6437 or +49 30 1234567",
    "4918187128635271 4918187128635272 4111-1111-1111-1111", "é 🙂 x@y.zz 10.0.0.1", "name [at] example [dot] com", "(578) 555-6437", "+1((((((((", "<|endoftext|> a<|endoftext|>",
    LONG, "a.a." * 5000 + "@", "1." * 5000, "same", "same", "the \x85 don't  stop\n\n x", "٣ 12 ́",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "z", 3) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "z", 3), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, shard int")


def strict_spans(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_strict_spans_equal_python(docs):
    found = pii.find_personal_data(docs.where("doc_id != 15")).collect()  # that text is quadratic for Python's engine
    for row in found:
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["base"]] == strict_spans(row["text"])
    assert len(found) == docs.count() - 2
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_masking(docs):
    out = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert out[0] is None and out[1] == "" and out[9] == "é 🙂 <EMAIL> <IP>"
    assert out[7] == "call <PHONE> or <PHONE>"
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns and {r["spans"] for r in masked.collect()} == {"z", None}


def test_spans_are_added_and_refused(spark):
    rows = [(i, f"mail me at user{i}@site.com or call +1 (578) 555-64{i:02d} from host 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"please call (578) 555-64{i:02d} today") for i in range(10)] + [(200 + i, f"order no. 178.555.64{i:02d} was sent") for i in range(30)]
    rows += [(300 + i, f"write to user{i} [at] site [dot] com") for i in range(10)] + [(400 + i, "pay by card 378282246310005 now") for i in range(5)] + [(500 + i, f"address 2001:0db8:0000:0000:0000:0000:1428:57a{i} here") for i in range(5)]
    rows += [(600, "serial part 1234567890123")]
    found = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]], s["base"]) for s in r["spans"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == [("email", "user0@site.com", True), ("ip", "10.0.0.0", True), ("phone", "+1 (578) 555-6400", True)]
    assert all(found[100 + i] == [("phone", f"(578) 555-64{i:02d}", False)] for i in range(10))
    assert all(found[200 + i] == [] for i in range(30)) and found[600] == []
    assert all(found[300 + i] == [("email", f"user{i} [at] site [dot] com", False)] for i in range(10))
    assert all(found[400 + i] == [("card", "378282246310005", False)] for i in range(5))


def test_columns_with_the_operators_names_stay(spark):
    names = ["_text", "_base", "_loose", "_email", "_ip", "text_of", "base_spans", "strict_email", "more_ip", "found_spans", "cell"]
    table = spark.createDataFrame([(1, "at a@b.cd", *["x"] * len(names))], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = pii.find_personal_data(table).first()
    assert [(s["kind"], s["start"]) for s in out["spans"]] == [("email", 3)] and all(out[c] == "x" for c in names)
    masked = pii.mask_personal_data(table)
    assert masked.columns == table.columns and masked.first()["text"] == "at <EMAIL>" and all(masked.first()[c] == "x" for c in names)


def test_texts_of_nothing_but_numbers(spark):
    text = "12 a 4918187128635271 " + "123, " * 30000
    assert [(s["kind"], s["start"]) for s in pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]] == [(k, a) for k, a, _ in strict_spans(text)]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(docs, shards):
    rows = sharding.shard_by_bytes(docs, shards).collect()
    assert len(rows) == len(TEXTS) + 2
    sizes = {}
    for r in rows:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]]
            assert r["size"] == len((text or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text or "").encode())
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"], -1 if r["doc_id"] is None else r["doc_id"]))
    for shard in sizes.values():
        assert sorted(x[0] for x in shard) == list(range(len(shard)))
    order = [x[2] for s in sorted(sizes) for x in sorted(sizes[s])]
    assert order == sorted(order)
    largest = max(r["size"] for r in rows)
    assert all(sum(x[1] for x in s) < sum(r["size"] for r in rows) / shards + largest for s in sizes.values())
    assert sharding.shard_by_bytes(docs.limit(0), shards).count() == 0


def test_bpe_equals_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for row in bpe.decode(bpe.encode(docs, path), path).collect():
        if row["doc_id"] is not None:
            text = TEXTS[row["doc_id"]] or ""
            assert row["ids"] == tokenizer.encode(text, add_special_tokens=False).ids and row["decoded"] == text
    assert bpe.encode(docs.limit(0), path).count() == 0
    apart = {(r["doc_id"], np.array(r["ids"], "<u4").tobytes(), r["decoded"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert {(r["doc_id"], bytes(r["packed"]), r["decoded"]) for r in bpe.round_trip(docs, path).collect()} == apart


def brute(vectors, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for qid in {i for i, _ in usable if i % 100 == 0}:
        q = min(v for i, v in usable if i == qid)
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in usable if i != qid and len(v) == len(q))[:k]
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k(spark):
    random = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in random.normal(size=4) * random.choice([0.1, 1, 5])]) for i in range(900)]
    vectors += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(900, 960)]
    vectors += [(1000, None), (1001, [float("nan")] * 4), (1002, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1003, [float("inf")] * 4), (1100, [1.0, 2.0]), (1101, [2.0, 2.0]), (1200, []), (1300, [0.0] * 4), (7, [3.0] * 4)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score int")
    for side, bucket in ((16 << 20, 256), (64 * 8 * 4, 16)):
        topk.SIDE_BYTES, topk.BUCKET, kept = side, bucket, (topk.SIDE_BYTES, topk.BUCKET)
        got = {tuple(r) for r in topk.exact_top_k(table, F.col("vec_id") % 100 == 0, 10).collect()}
        topk.SIDE_BYTES, topk.BUCKET = kept
        assert got == brute(vectors, 10)
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_digest_of_ids():
    assert hashlib.sha256(np.array([1, 70000], "<u4").tobytes()).hexdigest() == hashlib.sha256(bytes([1, 0, 0, 0, 112, 17, 1, 0])).hexdigest()
