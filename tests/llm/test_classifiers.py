import math
import random
import re
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from factloom.llm import language, toxicity
from factloom.llm.queries import TOXIC

SYLLABLES = {"en": "th er ing ou wh", "de": "sch ung ein ß ü", "fr": "eau oi é que ç", "es": "ción ñ rr ado ll"}


def word(r, lang):
    return "".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4)))


def test_language(spark):
    r = random.Random(1)
    rows = []
    for i in range(240):
        lang = r.choice(list(SYLLABLES))
        text = " ".join(word(r, lang) for _ in range(r.randint(8, 60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, None if i % 11 == 0 else lang, lang, "x"))
    rows += [(900, None, "en", "und", None), (901, "", "en", "und", None), (902, "123 !! ...", "en", "und", None), (None, "thering ouwh", "en", "en", None), (903, "schung ein " * 20000, None, "de", None), (903, "schung ein " * 20000, None, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, lang_pred string")
    held_out = language.remainder("doc_id", 5) == 0
    assert {x["doc_id"]: x["h"] for x in docs.select("doc_id", held_out.alias("h")).collect()}[17] == (zlib.crc32(b"17") % 5 == 0)
    model = language.fit(docs.where(~held_out))
    out = language.identify(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and sum(x["lang_pred"] != x["truth"] for x in got) <= 2
    assert all(0 <= x["score"] <= 1 for x in got)
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0))
    assert {x["lang_pred"] for x in language.identify(docs, nothing).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'de'"))
    assert {x["lang_pred"] for x in language.identify(docs.where("truth <> 'und'"), single).collect()} == {"de"}


def test_grammar_transducers():
    g = toxicity.Grammar({"idiot": 6.0, "trott*": 5.0}, toxicity._PRIOR, -3.0)
    at = lambda text: {toxicity.PATTERNS[i]: v for i, v in enumerate(g.patterns(text)) if v}
    assert at("what an idiot") == {"insult": 6.0}
    assert at("You are an IDIOT") == {"directed": 6.0}
    assert at("you are not an idiot") == {"negated": 6.0}
    assert at("he said something. idiot") == {"insult": 6.0}
    assert at("they wrote idiot") == {"reported": 6.0}
    assert at('never "idiot"') == {"denied": 6.0}
    assert at("I will kill you") == {} and at("you I will kill") == {"threat": 5.0}
    assert at("vertrottelt") == {} and at("Trottelei") == {"insult": 5.0}
    assert at("a clean text") == {}


def test_toxicity_is_learned(spark):
    r = random.Random(2)
    insults, rows, labels = ["blarg", "zonk", "fruppen", "fruppig", "fruppte"], [], []
    for i in range(600):
        toxic = r.random() < 0.2
        words = [word(r, "en") for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(insults))
        rows.append((i, " ".join(words), 0.5))
        if i % 10:
            labels.append((i, int(toxic), int(toxic)))
    rows += [(700, None, None), (701, "", None), (702, "zonk " * 50000, None), (None, "a blarg", None), (5, rows[5][1], 0.0)]
    labels += [(None, 1, 1), (8, None, 1), (labels[0][0], 0, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, truth int")
    learn = language.remainder("doc_id", 3) != 1
    grammar = toxicity.fit(docs, marks, learn)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, grammar).collect()}
    tested = [(got[i], y) for i, _, y in labels if i is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) != y for s, y in tested) <= 0.03 * len(tested)
    assert got[700] == got[701] < 0.5 and got[702] > 0.9
    assert toxicity.score(docs, grammar).count() == len(rows) and toxicity.score(docs.limit(0), grammar).count() == 0
    bare = toxicity.fit(docs, marks.limit(0), learn)
    assert len({round(x["score"], 9) for x in toxicity.score(docs, bare).collect()}) == 1


def test_copies_do_not_teach_insults(spark):
    rows = [(i, "a odd flimmer text zonk number " + "abcdefgh"[i % 8]) for i in range(40)] + [(100 + i, f"{chr(97 + i % 26) * (2 + i // 26)}x zonk here") for i in range(40)] + [(200 + i, f"plain{i} text here {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") < 200).cast("int").alias("toxic"))
    grammar = toxicity.fit(docs, marks, F.lit(True))
    assert "zonk" in grammar.lexicon and "flimmer" not in grammar.lexicon


def test_targets_direct_what_precedes_them(spark):
    g = toxicity.Grammar({"idiot": 6.0}, toxicity._PRIOR, -3.0)
    at = lambda text: {toxicity.PATTERNS[i]: v for i, v in enumerate(g.patterns(text, ahead=True)) if v}
    assert at("I will kill you") == at("you I will kill") == at("you I will kill you") == {"threat": 5.0}
    assert at("kill a b c you") == {"threat": 5.0} and at("kill a b c d you") == at("kill. you") == {}
    assert at("I will never kill you") == at("they wrote kill you") == {}
    assert at("an idiot are you") == at("you idiot you") == {"directed": 6.0} and at("not an idiot you") == {"negated": 6.0}
    docs = spark.createDataFrame([(1, "I will kill you"), (2, "you I will kill"), (3, ""), (4, "a clean text")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, marks, F.lit(True))).collect()}
    assert got[1] == got[2] > 0.7 > got[3] == got[4]


def plain_features(text):
    raw = f" {text.lower()} ".encode()
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
    counts = {}
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if not (b == 32 and 32 in (a, c)):
            k = ((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 20
            counts[k] = counts.get(k, 0) + 1
    size = sum(counts.values()) ** 0.5
    return {k: n**0.5 / size for k, n in counts.items()}


def plain_vote(machines, text):
    """Class and mean probability by a loop over all pairs."""
    x, votes, sums = plain_features(text), [0] * len(machines.classes), [0.0] * len(machines.classes)
    for (a, b), w, bias in zip(machines.pairs, machines.weights, machines.biases, strict=True):
        p = 1 / (1 + math.exp(-4 * (sum(w[k] * v for k, v in x.items()) + bias)))
        votes[a if p >= 0.5 else b] += 1
        sums[a] += p
        sums[b] += 1 - p
    n = len(machines.classes)
    best = max(range(n), key=lambda c: (votes[c], sums[c], -c))
    return best, (sums[best] / (n - 1) if n > 1 else 1.0)


def test_language_equals_a_plain_loop(spark):
    r = random.Random(5)
    syllables = SYLLABLES | {"nl": "ij oe aa sch g", "it": "zione gli che ò", "xx": "qq kz", "xy": "wv jj"}
    rows = [(i, lang, " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 30)))) for i in range(320) for lang in [sorted(syllables)[i % 8]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(docs)
    assert model.families.classes == ["germanic", "romance", "unlisted x"] and [m.classes for m in model.within] == [["de", "en", "nl"], ["es", "fr", "it"], ["xx", "xy"]]
    # One machine, trained again from all rows of its two languages.
    x = np.zeros((80, language.DIM), np.float32)
    pair = sorted((row for row in rows if row[1] in ("de", "nl")), key=lambda row: (row[1], row[0]))
    for i, row in enumerate(pair):
        for k, v in plain_features(row[2]).items():
            x[i, k] = v
    w, bias = language.linear_svm(x, np.array([row[1] == "de" for row in pair]))
    k = model.within[0].pairs.index((0, 2))
    assert np.allclose(model.within[0].weights[k], w, atol=1e-4) and abs(model.within[0].biases[k] - bias) < 1e-4
    long = "schung ein " * 200000
    for text, got in zip([t for _, _, t in rows[:80]] + [long], zip(*model.predict([t for _, _, t in rows[:80]] + [long]), strict=True), strict=True):
        family, sure = plain_vote(model.families, text)
        best, p = plain_vote(model.within[family], text)
        assert got[0] == model.within[family].classes[best] and abs(got[1] - min(1.0, sure * p)) < 1e-3


def test_ties_between_languages():
    pairs = [(0, 1), (0, 2), (1, 2)]
    weights = np.zeros((3, language.DIM), np.float32)
    x = np.zeros((1, language.DIM), np.float32)
    circle = language.Pairwise(["a", "b", "c"], pairs, weights, np.array([1, -1, 1], np.float32))  # a beats b, c beats a, b beats c
    assert circle.predict(x)[0][0] == 0
    surer = language.Pairwise(["a", "b", "c"], pairs, weights, np.array([1, -1, 2], np.float32))
    assert surer.predict(x)[0][0] == 1
    even = language.Pairwise(["a", "b"], [(0, 1)], weights[:1], np.zeros(1, np.float32))
    assert even.predict(x) == (np.array([0]), np.array([0.5]))


def plain_patterns(grammar, text):
    """The patterns of a text by looking around every word, without transducers."""
    out = dict.fromkeys(toxicity.PATTERNS, 0.0)
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        words, quotes = [], 0
        for w in regex.findall(r"[\p{L}\p{M}'’]+|[\"“”«»„]", clause):
            if w in "\"“”«»„":
                quotes += 1
                words.append(("R" if quotes % 2 else "o", 0))
            else:
                weight = grammar.weight(w)
                words.append(("i" if weight else "t" if w in toxicity.THREATS else "T" if w in toxicity.TARGETS else "N" if w in toxicity.NEGATIONS else "R" if w in toxicity.REPORTS else "o", weight or 5.0))
        for j, (kind, weight) in enumerate(words):
            if kind not in "it":
                continue
            reported = any(k == "R" for k, _ in words[:j])
            negated = any(k == "N" for k, _ in words[max(0, j - 4) : j])
            directed = any(k == "T" for k, _ in words[max(0, j - 4) : j] + words[j + 1 : j + 5])
            if kind == "i":
                out["denied" if reported and negated else "reported" if reported else "negated" if negated else "directed" if directed else "insult"] += weight
            elif directed and not reported and not negated:
                out["threat"] += weight
    return [out[p] for p in toxicity.PATTERNS]


def test_scores_equal_plain_reading():
    r, grammar = random.Random(8), toxicity.Grammar({"idiot": 6.0, "trott*": 5.0, "zonk": 4.0}, np.array([1.0, 1.2, 0.4, 0.4, 0.2, 1.0]), -3.0)
    vocabulary = ["idiot", "Trottel", "zonk", "zonks", "kill", "you", "du", "not", "never", "said", "wrote", '"', ".", "a", "word", "here", "!"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["", "idiot " * 20000]
    seen = np.array([grammar.patterns(t, ahead=True) for t in texts])
    assert np.allclose(seen, [plain_patterns(grammar, t) for t in texts]) and (seen.sum(0) > 0).all()
    z = seen @ grammar.weights + grammar.bias
    assert np.allclose(grammar.score(texts), 1 / (1 + np.exp(-np.clip(z, -60, 60))))


def test_a_score_at_the_bar_is_toxic(spark):
    at_bar = toxicity.Grammar({"zonk": 1.0}, np.zeros(6), math.log(0.7 / 0.3))
    scored = toxicity.score(spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string"), at_bar).collect()
    assert {round(x["score"], 12) for x in scored} == {0.7}
    below = spark.createDataFrame([(0.7,), (0.6999999,), (0.7000001,)], "score double").select((F.col("score") >= TOXIC).cast("int").alias("p"))
    assert [x["p"] for x in below.collect()] == [1, 0, 1]


def test_language_sample_with_one_id(spark, monkeypatch):
    r = random.Random(5)
    for only in (1, 2, None):
        rows = [(only, " ".join(word(r, lang) for _ in range(12)), lang) for lang in ("en", "de") for _ in range(400)] + [(only, "eauoi équeç", "fr")] * 50
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language.fit(docs)
        assert sorted(x for f in model.within for x in f.classes) == ["de", "en", "fr"]
        got = language.identify(docs, model).collect()
        assert sum(x["lang_pred"] != x["lang"] for x in got) <= 10


def test_language_sample_keeps_its_bound_and_rare_languages(spark):
    rows = [(7, f"thing {i}", "en") for i in range(600)] + [(i, f"ting {k}", f"x{k}") for k in range(30) for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x for f in model.within for x in f.classes) == sorted(["en", *(f"x{k}" for k in range(30))])


def test_drawn_rows_are_those_of_the_least_hashes(spark, monkeypatch):
    rows = [(i, f"thing {i % 900}", "en" if i % 7 else "de") for i in range(4000)] + [(1, "thing one", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashes = docs.select("lang", F.xxhash64(F.lit("language"), "doc_id", "text").alias("h")).distinct().collect()
    expected = {x: sorted(r["h"] for r in hashes if r["lang"] == x)[:20] for x in ("en", "de")}
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    monkeypatch.setattr(language, "AMPLE", 1.1)  # a first bar that is too low for one of them has to be raised
    seen, plain = {}, language._by_name
    monkeypatch.setattr(language, "_by_name", lambda values: seen.update(values) or plain(values))
    language.fit(docs)
    assert seen == {x: own[-1] for x, own in expected.items()}
