"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Features are hashed letter trigrams of the whole text, damped by square root and scaled to unit length. Both levels vote
over pairwise linear support vector machines, trained here on a bounded sample of labelled rows per language. Prediction is
one pass over the documents where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Features, training rows of a language (and of all languages together) at most, steps and regularisation of a machine.
DIM, PER_LANGUAGE, ALL_LANGUAGES, STEPS, PENALTY = 4096, 250, 5000, 150, 1e-3
#: How many times the wanted rows of a language are looked at when its sample is drawn.
AMPLE = 8
UNKNOWN = "und"
# Language families by public language codes; languages not listed form a family by their first letter.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ne ur",
    "semitic": "ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
#: Texts whose vectors are held at once, and bytes of a text that are looked at at once.
_SLICE, _BYTES = 128, 1 << 20


def family_of(language: str) -> str:
    """The family's name; ``unlisted`` ones are few, so that pairs of families do not grow with the labels."""
    return _FAMILY.get(language.lower().split("-")[0]) or f"unlisted {language[:1].lower()}"


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed trigrams over lower-cased letters, other ASCII being blank."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        raw, counts = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8), 0
        for at in range(0, len(raw) - 2, _BYTES):  # a long text in parts that share two bytes
            low = _FOLD[raw[at : at + _BYTES + 2]]
            blank = low == 32
            codes = (low[:-2] << 16 | low[1:-1] << 8 | low[2:])[~(blank[1:-1] & (blank[:-2] | blank[2:]))]
            counts = counts + np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        out[i] = np.sqrt(counts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def linear_svm(x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated full gradients; the classes count alike."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, ahead_b, momentum, rate = w, b, 1.0, 0.2
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_b)) * y * share
        new, new_b = ahead + rate * (2 * (slack @ x) - PENALTY * ahead), ahead_b + rate * 2 * float(slack.sum())
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / following
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b, momentum = new, new_b, following
    return w, b


@dataclass
class Pairwise:
    """One-versus-one machines over ``classes``, for each pair (positions) its weights and bias."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    biases: np.ndarray

    @classmethod
    def of(cls, level: str, classes: list[str], machines: dict[tuple[str, str, str], tuple[np.ndarray, float]]) -> Pairwise:
        pairs = list(combinations(range(len(classes)), 2))
        found = [machines[level, classes[a], classes[b]] for a, b in pairs]
        return cls(classes, pairs, np.array([w for w, _ in found], np.float32).reshape(len(pairs), DIM), np.array([b for _, b in found], np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's class number and its mean pairwise probability; most votes win, ties go to the larger probability."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        p = 1 / (1 + np.exp(-4 * (x @ self.weights.T + self.biases).astype(np.float64)))
        votes, mean = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
            mean[:, a] += p[:, k] / (len(self.classes) - 1)
            mean[:, b] += (1 - p[:, k]) / (len(self.classes) - 1)
        best = (votes + mean * 0.5).argmax(1)
        return best, mean[np.arange(len(x)), best]


@dataclass
class Hierarchy:
    families: Pairwise
    within: list[Pairwise]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language (``und`` without a letter) and score of each text."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.families.classes else []
        for at in range(0, len(known), _SLICE):
            rows = known[at : at + _SLICE]
            x = features([texts[i] for i in rows])
            family, sure = self.families.predict(x)
            for f in np.unique(family):
                mine = np.flatnonzero(family == f)
                best, p = self.within[f].predict(x[mine])
                for k, b, q in zip(mine.tolist(), best.tolist(), p.tolist(), strict=True):
                    names[rows[k]], scores[rows[k]] = self.within[f].classes[b], min(1.0, max(0.0, float(sure[k]) * q))
        return names, scores


def _by_name(values: dict[str, int]) -> Column:
    """The language's value, null for others."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")] if values else F.lit(None).cast("long")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """A model from the rows with a language and a letter: of each language those with the least hashes of id and text.

    At most PER_LANGUAGE rows of a language are drawn, fewer with so many languages that ALL_LANGUAGES would not do for
    them, but two of each, if it has them. Rows that agree in id, language and text count once; a null id is one too.
    A row's vector goes to the pairs that its language and its family take part in; every pair is trained in one task, from
    a bounded number of rows, and only weights come to the driver.
    """
    small_batches(labelled)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("language"), "id", "text"))
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # one row a language
    each = min(PER_LANGUAGE, max(2, ALL_LANGUAGES // max(1, len(sizes))))
    # A first bar lets about AMPLE times the wanted rows of a language pass, whatever its size; their hashes are few.
    shares, bars = {name: min(1.0, AMPLE * each / n) for name, n in sizes.items()}, {}
    while shares:
        passes = F.col("h") <= _by_name({name: min(2**63 - 1, int(share * 2**64) - 2**63) for name, share in shares.items()})
        found = {r[0]: r[1] for r in rows.where(passes).select("lang", "h").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("h"))).collect()}
        bars |= {name: found[name][:each][-1] for name, share in shares.items() if len(found.get(name, ())) >= each or share == 1}
        shares = {name: min(1.0, AMPLE * share) for name, share in shares.items() if name not in bars}
    drawn = rows.where(F.col("h") <= _by_name(bars)).dropDuplicates(["lang", "h"])
    languages = sorted(bars)
    families = sorted({family_of(x) for x in languages})
    within = [[x for x in languages if family_of(x) == f] for f in families]
    pairs = [("family", a, b) for a, b in combinations(families, 2)] + [("language", a, b) for some in within for a, b in combinations(some, 2)]
    takes = {x: [k for k, (level, a, b) in enumerate(pairs) if (family_of(x) if level == "family" else x) in (a, b)] for x in languages}

    def vectors(batches):
        for batch in batches:
            names = batch.column(2).to_pylist()
            own = [k for x in names for k in takes[x]]
            at = np.repeat(np.arange(len(names)), [len(takes[x]) for x in names])
            x = pa.array([v.tobytes() for v in features(batch.column(1).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(c.take(pa.array(at)) for c in (batch.column(0), batch.column(2), x))], names=["pair", "id", "lang", "x"])

    def machine(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("id", "ascending"), ("x", "ascending")])
        level, first, _ = pairs[table.column("pair")[0].as_py()]
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("x").to_pylist()])
        positive = np.array([(family_of(n) if level == "family" else n) == first for n in table.column("lang").to_pylist()])
        w, bias = linear_svm(x, positive)
        return pa.table({"pair": table.column("pair")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    machines = {}
    if pairs:
        kind = labelled.schema[id_col].dataType.simpleString()
        sent = drawn.select("id", "text", "lang").mapInArrow(vectors, f"pair int, id {kind}, lang string, x binary")
        trained = sent.groupBy("pair").applyInArrow(machine, "pair int, w binary, bias double").toArrow()  # one row a pair
        for k, w, bias in zip(*(trained.column(c).to_pylist() for c in range(3)), strict=True):
            machines[pairs[k]] = np.frombuffer(w, np.float32), bias
    return Hierarchy(Pairwise.of("family", families, machines), [Pairwise.of("language", some, machines) for some in within])


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; that of a null id is that of no text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % n


def identify(docs: DataFrame, model: Hierarchy, text_col: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``predicted`` and ``score`` (0 to 1) for every whole text; input columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0; without any learned language all are. Ids and labels play
    no part, so null ids and repeated rows are predicted alike; an empty table stays empty.
    """
    docs = docs.drop(predicted, score)
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, scores = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, predicted, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(predicted, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)
