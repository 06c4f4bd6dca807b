"""The alignment of two tokenizers against loops over every pair of tokens."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment
from factloom.llm.queries import PIECES, VOCABULARY

TEXTS = [
    None, "", " ", "Hello world, hello worlds", "Hello world, hello worlds", "naïve café 🙂 ünïcode\n\n\tx", "a▁b", "<|endoftext|> <s></s> <0x41>", "\x00\x85  trailing  ",
    "a" * 5000, "the same words again and again " * 3000, "tokenization", "12345 67,890.12", "tokenization of the same words", "ｆｕｌｌ ｗｉｄｔｈ 漢字かな",
]


def loops(texts):
    """n_a .. groups of each text by comparing every token of one side with every token of the other that can overlap it."""
    a_lib, b_lib = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    letters = alignment._byte_letters()
    spans, links = [], []
    for text in texts:
        a = [(i, bytes(letters[x] for x in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text or "")]
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        placed = []
        for side in (a, b):
            at, out = 0, []
            for i, piece in side:
                out.append((i, at, at + len(piece)))
                at += len(piece)
            placed.append(out)
        spans.append(placed)
        from_b, pairs = 0, []
        for i, start, end in placed[0]:
            while from_b < len(placed[1]) and placed[1][from_b][2] <= start:
                from_b += 1
            k = from_b
            while k < len(placed[1]) and placed[1][k][1] < end:
                pairs.append((i, placed[1][k][0]))
                k += 1
        links.append(pairs)
    count = Counter(pair for pairs in links for pair in set(pairs))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (a, b), pairs in zip(spans, links, strict=True):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < high) for side in (a, b)) if len(ends) < 3000 else None)
        out.append((len(a), len(b), len(ends), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), ";".join(groups) if None not in groups else None))
    return out, count


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, 2), (None, "null id", "g", 3)], "doc_id long, text string, groups string, a_ids int")


@pytest.mark.parametrize("bounds", [None, (40, 50, 7)])
def test_links_equal_loops(spark, docs, monkeypatch, bounds):
    if bounds:  # many slices, partial counts and shards
        for name, value in zip(("SLICE_TOKENS", "HELD_KEYS", "SHARD_KEYS"), bounds, strict=True):
            monkeypatch.setattr(alignment, name, value)
    rows = docs.collect()
    expected, count = loops([r["text"] for r in rows])
    found = alignment.align(docs, VOCABULARY, PIECES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found = sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect()), key=lambda r: r[0])
    expected = sorted(((-1 if r["doc_id"] is None else r["doc_id"], *e) for r, e in zip(rows, expected, strict=True)), key=lambda r: r[0])
    for mine, theirs in zip(found, expected, strict=True):
        assert mine[:7] == theirs[:7] and (theirs[7] is None or mine[7] == theirs[7])


def test_pair_table(spark, docs):
    _, count = loops([r["text"] for r in docs.collect()])
    tokens = alignment.tokenise(docs, VOCABULARY, PIECES).cache()
    counts = alignment.count_pairs(tokens, VOCABULARY, PIECES)
    rows = alignment.pair_table(spark, counts).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in rows} == count and len(rows) == len(count)
    assert all(r["is_best"] == (r["n"] == max(n for (a, _), n in count.items() if a == r["a_id"])) for r in rows)


def test_empty_table_and_other_id_types(spark, docs):
    assert alignment.align(docs.limit(0), VOCABULARY, PIECES).count() == 0
    named = spark.createDataFrame([("x", "one two")], "key string, body string")
    assert alignment.align(named, VOCABULARY, PIECES, "key", "body").first()["key"] == "x"


def test_vocabularies_out_of_merge_order_are_refused(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="merge order"):
        alignment.byte_level(str(path))
