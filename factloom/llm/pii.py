"""Personal data by weak supervision, in DataFrame expressions only.

Candidates come from strict patterns (the base kinds) and looser ones. Five labelers vote +1, -1 or 0 on every candidate: two
regex labelers (shape and check), a gazetteer, and two context labelers (words that announce personal data, words that
announce other numbers). Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and
each pattern's probability; these soft labels train the final span classifier (naive Bayes over votes and shape). It decides
on the looser candidates; strict ones stay. The model is a few hundred numbers, whatever the number of rows; texts are
scanned twice and never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, col, fresh, let

#: Kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# Strict patterns. Possessive runs and look-behinds only keep long texts linear; the matches are those of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ; [0-9]([\x20-]?[0-9])+ ;
# \+[0-9][\x20().0-9-]+[0-9]
_STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without any of these has no candidate of the kind.
_NEEDS = {"email": ("@",), "phone": ("+",)}
_LOOSE_NEEDS = {"email": ("[at]", "(at)"), "ip": (":",)}
#: Most runs of digits are no card: only these lengths are kept, so that a text of nothing but numbers stays linear.
_KEEPS = {"card": lambda hit: F.length(hit).between(13, 40)}
# Fixed gazetteers and context words.
_TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at"
_SHORTER_CARDS = "^(?:3[47][0-9]{13}|4[0-9]{12})$"
_CARD_PREFIX = "^(?:3[47]|4|5[1-5]|2[2-7]|6011|65|35)"
_CUES = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|amex|credit|pay|ip|address|host|server|write|reach)"
_OTHER_NUMBERS = r"(?i)(?:order|invoice|version|isbn|issn|serial|build|ticket|item|ref|part|no\.|nr\.|#)"
#: Characters before a span in which context words count, rounds of expectation-maximisation, and the classifier's bar (log odds).
CONTEXT, ROUNDS, BAR = 32, 25, 0.0
_LABELERS = 5
_SPAN = "array<struct<start:int,end:int,hit:string>>"


def _any_of(text: Column, needs: tuple[str, ...]) -> Column | None:
    return reduce(or_, [F.contains(text, F.lit(x)) for x in needs]) if needs else None


def _matches(text: Column, pattern: str, needs: Column | None = None, keep=None) -> Column:
    """start, end (code points, end exclusive) and text of the leftmost non-overlapping matches that ``keep`` holds for."""
    none = F.array().cast(_SPAN)

    def placed(hits: Column, gaps: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(hits, i))
            more = F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(hits, i).alias("hit"))))
            return F.struct(end.alias("at"), (more if keep is None else F.when(keep(F.get(hits, i)), more).otherwise(state["out"])).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, step, lambda s: s["out"])

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(none),
    )
    return F.when(needs, found).otherwise(none) if needs is not None else found


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    """Whether a strict match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(hit) > 40, F.lit(False)).otherwise(let(_digits(hit), lambda d: F.length(d).between(16, 19) & _luhn(d)))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _cell(kind: str, text: Column, span: Column, strict: Column) -> Column:
    """kind, the five votes and the shape of a candidate, as one string."""
    hit, digits = span["hit"], _digits(span["hit"])
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(F.lit(CONTEXT), span["start"]))
    check, listed = {
        "email": (_vote(hit.rlike(r"[A-Za-z]{2,}$"), ~hit.rlike(r"[A-Za-z]{2,}$")), _vote(hit.rlike(rf"(?i)(?:{_TOP_DOMAINS})$"))),
        "ip": (_vote(F.length(hit) >= 7), _vote(~hit.rlike(r"^(?:0|127|255)\."), hit.rlike(r"^(?:0|127|255)\."))),
        "card": (_vote((F.length(hit) <= 40) & _luhn(F.substring(digits, 1, 40)), F.lit(True)), _vote(digits.rlike(_CARD_PREFIX), ~digits.rlike(_CARD_PREFIX))),
        "phone": (_vote(F.length(digits).between(10, 13), ~F.length(digits).between(8, 15)), _vote(digits.rlike("^[2-9]") | strict, digits.rlike("^[01]"))),
    }[kind]
    tidy = {"email": hit.rlike(r"^[A-Za-z0-9]"), "ip": ~hit.rlike("0{2,}"), "card": hit.rlike(r"^[0-9]+$|^(?:[0-9]{4}[ -]){3}"), "phone": hit.rlike(r"\(|\+")}[kind]
    votes = [_vote(tidy), check, listed, _vote(before.rlike(_CUES)), _vote(F.lit(False), before.rlike(_OTHER_NUMBERS))]
    shape = F.concat(F.least(F.length(hit) / 4, F.lit(12)).cast("int").cast("string"), F.when(hit.rlike(r"[\x20]"), F.lit("s")).otherwise(F.lit("")), F.when(hit.rlike("-"), F.lit("h")).otherwise(F.lit("")))
    return F.concat_ws("|", F.lit(kind), *[v.cast("string") for v in votes], shape)


def _candidates(docs: DataFrame, text_col: str, base_col: str, loose_col: str) -> DataFrame:
    """``docs`` with ``base_col`` (kind, start, end, cell) and ``loose_col`` (the same for candidates beyond the strict ones)."""
    text, *found = fresh(docs, "text_of", *(f"strict_{k}" for k in KINDS), *(f"more_{k}" for k in _LOOSE))
    strict, more = dict(zip(KINDS, found, strict=False)), dict(zip(_LOOSE, found[len(KINDS) :], strict=True))
    own = [col(c) for c in docs.columns]
    out = docs.select(*own, F.coalesce(col(text_col), F.lit("")).alias(text))
    out = out.select(
        *own, text, *[_matches(F.col(text), _STRICT[k], _any_of(F.col(text), _NEEDS.get(k, ())), _KEEPS.get(k)).alias(c) for k, c in strict.items()], *[_matches(F.col(text), _LOOSE[k], _any_of(F.col(text), _LOOSE_NEEDS.get(k, ()))).alias(c) for k, c in more.items()]
    )

    def spans(kind: str, column: str, is_strict: bool, keep) -> Column:
        return F.transform(
            F.filter(column, keep),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _cell(kind, F.col(text), s, F.lit(is_strict)).alias("cell")),
        )

    passing = lambda kind: lambda s: _holds(kind, s["hit"])
    base = F.concat(*[spans(k, c, True, passing(k)) for k, c in strict.items()])
    shorter = lambda d: d.rlike(_SHORTER_CARDS) & _luhn(d)
    cards = spans("card", strict["card"], False, lambda s: F.when(F.length(s["hit"]) > 40, F.lit(False)).otherwise(let(_digits(s["hit"]), shorter)))
    loose = F.concat(cards, *[spans(k, c, False, lambda s: F.lit(True)) for k, c in more.items()])
    out = out.select(*own, base.alias(base_col), loose.alias(loose_col))
    free = F.filter(loose_col, lambda s: ~F.exists(base_col, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(*own, base_col, F.when(F.size(loose_col) > 0, free).otherwise(F.col(loose_col)).alias(loose_col))


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def label_model(cells: DataFrame) -> DataFrame:
    """kind, cell, n, posterior and score (log odds of the span classifier) for each distinct kind, vote pattern and shape.

    ``cells`` has one row a candidate (kind, cell). All that follows the count is small: 3^5 vote patterns a kind, and shapes.
    """
    parts = F.split("cell", r"\|")
    counted = cells.groupBy("kind", "cell").agg(F.count("*").cast("double").alias("n"))
    counted = checkpointed(counted.select("kind", "cell", "n", F.transform(F.slice(parts, 2, _LABELERS), lambda x: x.cast("int")).alias("v"), F.element_at(parts, -1).alias("shape")))
    patterns = counted.groupBy("kind", "v").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("cells"))
    every = F.sequence(F.lit(0), F.lit(_LABELERS - 1))

    def likelihood(x: Column, plus: Column, minus: Column) -> Column:
        part = lambda j: F.when(F.get(x["v"], j) == 1, F.get(plus, j)).when(F.get(x["v"], j) == -1, F.get(minus, j)).otherwise(1 - F.get(plus, j) - F.get(minus, j))
        return F.aggregate(every, F.lit(1.0), lambda a, j: a * part(j))

    def posterior(x: Column, m: Column) -> Column:
        return let(F.struct((m["prior"] * likelihood(x, m["plus1"], m["minus1"])).alias("a"), ((1 - m["prior"]) * likelihood(x, m["plus0"], m["minus0"])).alias("b")), lambda s: s["a"] / (s["a"] + s["b"]))

    def soft_of(m: Column) -> Column:
        return F.transform("cells", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x, m).alias("p")))

    def step(m: Column, _: Column) -> Column:
        def updated(soft: Column) -> Column:
            def rate(yes: bool, vote: int) -> Column:
                w = lambda x: x["n"] * (x["p"] if yes else 1 - x["p"])
                return F.transform(every, lambda j: (_total(soft, lambda x: F.when(F.get(x["v"], j) == vote, w(x)).otherwise(F.lit(0.0))) + 1) / (_total(soft, w) + 3))

            prior = (_total(soft, lambda x: x["n"] * x["p"]) + 1) / (_total(soft, lambda x: x["n"]) + 2)
            return F.struct(prior.alias("prior"), rate(True, 1).alias("plus1"), rate(True, -1).alias("minus1"), rate(False, 1).alias("plus0"), rate(False, -1).alias("minus0"))

        return let(soft_of(m), updated)

    flat = lambda x: F.array(*[F.lit(x)] * _LABELERS)
    start = F.struct(F.lit(0.7).alias("prior"), flat(0.7).alias("plus1"), flat(0.1).alias("minus1"), flat(0.2).alias("plus0"), flat(0.5).alias("minus0"))
    fitted = patterns.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    soft = checkpointed(fitted.select("kind", F.explode(soft_of(F.col("m"))).alias("s")).select("kind", "s.v", "s.p"))

    # The span classifier: naive Bayes over votes and shape, from the soft labels.
    labelled = counted.join(soft, ["kind", "v"])
    yes, no = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
    odds = F.log((yes + 1) / (no + 1))
    feature = F.concat(F.transform("v", lambda x, j: F.concat_ws(":", j.cast("string"), x.cast("string"))), F.array(F.concat(F.lit("shape:"), F.col("shape"))))
    featured = labelled.withColumn("feature", F.explode(feature))
    prior = labelled.groupBy("kind").agg(odds.alias("prior"))
    weights = featured.groupBy("kind", "feature").agg(odds.alias("odds"))
    added = featured.join(weights, ["kind", "feature"]).join(prior, "kind").groupBy("kind", "cell", "n", "prior", F.col("p").alias("posterior")).agg(F.sum(F.col("odds") - F.col("prior")).alias("by_feature"))
    return added.select("kind", "cell", "n", "posterior", (F.col("prior") + F.col("by_feature")).alias("score"))


def _found(docs: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    base, loose = fresh(docs, "base_spans", "loose_spans")
    found = _candidates(docs, text_col, base, loose)
    model = label_model(found.select(F.explode(F.concat(base, loose)).alias("c")).select("c.kind", "c.cell"))
    good = sorted(r["cell"] for r in model.where(F.col("score") > BAR).select("cell").collect())  # bounded as the model is
    accepted = F.filter(loose, lambda s: s["cell"].isin(good)) if good else F.slice(loose, 1, 0)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    as_span = lambda is_base: lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(is_base).alias("base"))
    spans = F.array_sort(F.concat(F.transform(base, as_span(True)), F.transform(accepted, as_span(False))))
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(*[col(c) for c in docs.columns], spans.alias(spans_col))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base), in the order of ``KINDS``, then start.

    Offsets are code points, end exclusive. Base spans are the strict patterns' matches that pass their checks; others
    were added by the classifier and overlap no base span. A null or empty text has no spans; ids play no part, so null
    ids and repeated rows keep theirs; an empty table stays empty. An input column named spans is replaced, all others stay.
    """
    return _found(docs.drop("spans"), text_col, "spans")


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_personal_data`` replaced by ``<KIND>``; overlapping spans become one mark.

    All columns stay as they are, whatever their names; a null text stays null, repeated rows are masked alike.
    """
    (name,) = fresh(docs, "found_spans")
    found = _found(docs, text_col, name)
    by_start = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = col(text_col)

    def step(state: Column, s: Column) -> Column:
        cut = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(cut))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(by_start, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    masked = F.when(text.isNotNull() & (F.size(name) > 0), masked).otherwise(text)
    return found.select(*[masked.alias(c) if c == text_col else col(c) for c in docs.columns])
