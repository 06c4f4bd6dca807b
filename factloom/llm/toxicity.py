"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon of insults (whole words and word stems) with log-odds weights is learned from labelled rows. A text is cut into
clauses; a clause becomes a string of symbols (insult, threat, target, negation, report, other) that runs through composed
transducers: reported speech marks what follows as reported, negation marks what follows nearby as negated, a target nearby
makes an insult or threat directed: one before it in the same run, one after it in a second run from right to left. Only what survives as matched pattern scores, by weights that a logistic regression
learns around fixed priors. Clauses without a lexicon or threat word score nothing, so most text is passed by an automaton.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: Labelled rows to learn from at most; least toxic documents and log odds of a lexicon entry, entries at most; stem lengths.
TRAIN_ROWS, SUPPORT, ODDS, ENTRIES, STEMS = 30_000, 3, 3.0, 5000, range(4, 9)
# Function words of the grammar in four languages.
TARGETS = frozenset("you your yours u ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros he she they them him her sie er ihn ihm".split())
NEGATIONS = frozenset("not no never n't don't isn't aren't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca ningún ni sin without ohne sans".split())
REPORTS = frozenset("said says say called calls wrote writes reported quoted claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió allegedly".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn murder töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir".split())
_WORD = regex.compile(r"[\p{L}\p{M}'’]+|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PATTERNS = ("insult", "directed", "negated", "reported", "denied", "threat")
_PRIOR = np.array([1.0, 1.2, 0.4, 0.4, 0.2, 1.0])
_REACH = 4


@dataclass(frozen=True)
class Transducer:
    """Deterministic letter transducer; ``arcs`` gives (next state, output) by (state, symbol), else the symbol passes and ``rest`` gives the next state."""

    start: int
    arcs: dict
    rest: dict = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)

    def then(self, other: Transducer, alphabet: list[str]) -> Transducer:
        """The composition: the output of this one is the input of ``other``."""
        number, todo, arcs = {(self.start, other.start): 0}, [(self.start, other.start)], {}
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, middle = self.step(a, symbol)
                b2, out = other.step(b, middle)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                arcs[number[a, b], symbol] = (number[a2, b2], out)
        return Transducer(0, arcs)


def _grammar() -> Transducer:
    said = {(s, "R"): (1, "o") for s in (0, 1)} | {(1, c): (1, c + "r") for c in "it"}
    report = Transducer(0, said)
    negation = {(s, "N"): (_REACH, "o") for s in range(_REACH + 1)}
    negation |= {(s, c + m): (s - 1, c + ("d" if m else "n")) for s in range(1, _REACH + 1) for c in "it" for m in ("", "r")}
    near = {s: s - 1 for s in range(1, _REACH + 1)}
    deny = Transducer(0, negation, near)
    aim = {(s, "T"): (_REACH, "o") for s in range(_REACH + 1)}
    aim |= {(s, "i"): (s - 1, "I") for s in range(1, _REACH + 1)} | {(s, "t"): (s - 1, "K") for s in range(1, _REACH + 1)}
    target = Transducer(0, aim, near)
    alphabet = ["o", "i", "t", "T", "N", "R"]
    return report.then(deny, alphabet).then(target, alphabet)


GRAMMAR = _grammar()
#: Runs over GRAMMAR's output from right to left, with targets marked again: directs what a target follows.
AHEAD = Transducer(
    0,
    {(s, "T"): (_REACH, "o") for s in range(_REACH + 1)} | {(s, c): (s - 1, d) for s in range(1, _REACH + 1) for c, d in (("i", "I"), ("t", "K"))},
    {s: s - 1 for s in range(1, _REACH + 1)},
)
_PATTERN = {"i": 0, "I": 1, "in": 2, "ir": 3, "id": 4, "K": 5}


def words_of(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{M}]+", text.lower())


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if len(word) > 2 else []


def terms_of(text: str) -> set[str]:
    """A text's distinct words and, marked by a star, stems (beginnings of longer words)."""
    return {t for w in set(words_of(text)) for t in _terms(w)}


def contexts_of(text: str, among: frozenset[str]) -> set[tuple[str, str]]:
    """The terms of ``among`` in a text, each with the word before it."""
    words = words_of(text)
    return {(t, before) for before, w in zip(["", *words], words) for t in _terms(w) if t in among}


@dataclass
class Grammar:
    """Lexicon weights, pattern weights and bias; scores texts."""

    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "bias": self.bias}

    @property
    def automaton(self):
        if "_automaton" not in self.__dict__:
            made = ahocorasick.Automaton()
            for term in [*self.lexicon, *THREATS]:
                made.add_word(term.rstrip("*"), True)
            made.make_automaton()
            self.__dict__["_automaton"] = made
        return self.__dict__["_automaton"]

    def weight(self, word: str) -> float:
        found = [self.lexicon[t] for t in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)) if t in self.lexicon]
        return max(found, default=0.0)

    def patterns(self, text: str, ahead: bool = False) -> np.ndarray:
        """The summed lexicon weights of each pattern over the text's clauses; a threat counts 5.

        Without ``ahead`` only the first run counts, in which targets direct what follows them; ``fit`` and ``score`` take both.
        """
        out = np.zeros(len(PATTERNS))
        low = text.lower()
        if not any(True for _ in self.automaton.iter(low)):
            return out
        for clause in _CLAUSE.split(low):
            if not any(True for _ in self.automaton.iter(clause)):
                continue
            state = GRAMMAR.start
            quotes = 0
            run: list[tuple[str, float]] = []
            for word in _WORD.findall(clause):
                if word in "\"“”«»„":
                    quotes += 1
                    state, _ = GRAMMAR.step(state, "R" if quotes % 2 else "o")
                    run.append(("o", 0.0))
                    continue
                weight = self.weight(word)
                symbol = "i" if weight else "t" if word in THREATS else "T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "o"
                state, made = GRAMMAR.step(state, symbol)
                run.append(("T" if symbol == "T" else made, weight or 5.0))
            state = AHEAD.start
            for made, weight in reversed(run):
                if ahead:
                    state, made = AHEAD.step(state, made)
                if made in _PATTERN:
                    out[_PATTERN[made]] += weight
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.patterns(t, ahead=True) if t else np.zeros(len(PATTERNS)) for t in texts]).reshape(len(texts), len(PATTERNS))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Non-negative pattern weights near their priors and a bias, by full gradients over rows that count so many ``times``."""
    w, b, share = _PRIOR.copy(), -2.0, times / times.sum()
    for _ in range(400):
        wrong = (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y) * share
        w = np.maximum(0.0, w - 0.01 * (x.T @ wrong + penalty * (w - _PRIOR)))
        b -= 0.5 * wrong.sum()
    return w, b


def lexicon_of(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, tested: int) -> dict[str, float]:
    """Terms with their log odds, if support, odds and evidence suffice; a term that a shorter stem covers is left out.

    The evidence is a likelihood ratio that has to outweigh the number of terms ``tested``.
    """
    odds = {}
    for term, c in toxic.items() if n_clean else ():
        other = clean.get(term, 0)
        value = np.log((c + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_clean + 1))
        share, both = n_toxic / (n_toxic + n_clean), c + other
        ratio = c * np.log(c / (both * share)) + (other * np.log(other / (both * (1 - share))) if other else 0.0)
        if c >= SUPPORT and value >= ODDS and ratio >= np.log(max(tested, 2)):
            odds[term] = float(value)
    kept: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"))):
        word = term.rstrip("*")
        if not any(kept.get(word[:n] + "*", 0) >= odds[term] - 1.5 for n in STEMS if n <= len(word)):
            kept[term] = odds[term]
    return dict(sorted(kept.items(), key=lambda x: -x[1])[:ENTRIES])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar from the labelled documents for whose label row ``learn`` holds, TRAIN_ROWS at most, drawn by a hash of the id.

    Repeated labels of an id count as the largest; null labels and ids do not count. The drawn documents are picked once, by a
    join with their ids (TRAIN_ROWS at most), and kept; what learns reads only those.
    """
    small_batches(docs)
    usable = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    drawn = checkpointed(usable.orderBy(F.xxhash64(F.lit("toxicity"), id_col), id_col).limit(TRAIN_ROWS).select(F.col(id_col).alias("_id"), "y"))
    pairs = checkpointed(docs.join(F.broadcast(drawn), F.col(id_col) == F.col("_id")).select("y", F.coalesce(text_col, F.lit("")).alias("text")))

    def taught(batch):
        return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def count(wanted: int, among=None):
        def run(batches):
            for batch in batches:
                rows = [t for y, t in taught(batch) if y == wanted]
                totals = Counter(x for t in rows for x in (terms_of(t) if among is None else terms_of(t) & among.value))
                yield pa.RecordBatch.from_arrays([pa.array(["", *totals], pa.string()), pa.array([len(rows), *totals.values()], pa.int64())], names=["term", "n"])

        return pairs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    def collected(counted: DataFrame) -> dict[str, int]:
        table = counted.toArrow()
        return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))

    # Terms on SUPPORT of the bounded sample's toxic documents: bounded like the sample.
    toxic = collected(count(1).where((F.col("n") >= SUPPORT) | (F.col("term") == "")))
    n_toxic = toxic.pop("", 0)
    clean = collected(count(0, docs.sparkSession.sparkContext.broadcast(frozenset({*toxic, ""}))))
    n_clean = clean.pop("", 0)
    tested = len(toxic)
    likely = docs.sparkSession.sparkContext.broadcast(frozenset(lexicon_of(toxic, clean, n_toxic, n_clean, tested)))

    def contexts(batches):
        for batch in batches:
            found = sorted({x for y, t in taught(batch) if y == 1 for x in contexts_of(t, likely.value)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["term", "before"])

    # Support counts different words before a term, so that copies of one toxic document do not make its words insults.
    distinct = pairs.mapInArrow(contexts, "term string, before string").distinct().groupBy("term").agg(F.count("*").alias("n"))
    support = {t: min(toxic[t], n) for t, n in collected(distinct).items()}
    lexicon = lexicon_of(support, clean, n_toxic, n_clean, tested)
    grammar = Grammar(lexicon, _PRIOR.copy(), -3.0)
    if n_toxic and n_clean:
        sent = docs.sparkSession.sparkContext.broadcast(grammar)

        def examples(batches):
            for batch in batches:
                rows = Counter((y, *sent.value.patterns(t, ahead=True).round(3).tolist()) for y, t in taught(batch))
                yield pa.RecordBatch.from_arrays([pa.array([list(map(float, k)) for k in rows], pa.list_(pa.float64())), pa.array(list(rows.values()), pa.int64())], names=["x", "n"])

        seen = pairs.mapInArrow(examples, "x array<double>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").toArrow()
        x = np.array(seen.column(0).to_pylist())
        grammar.weights, grammar.bias = _logistic(x[:, 1:], x[:, 0], np.array(seen.column(1), float))
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1, higher: likelier toxic) of every whole text; a null or empty text has the score of no pattern.

    Null ids and repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
