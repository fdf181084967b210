"""Toxicity classifier with counterfactual regularisation.

A text's features are the words it has, and the beginnings of 4 and 5 letters of
longer words, each counted once. A logistic model is fitted to labelled rows; in
addition, identity terms in the labelled texts are swapped for others of their
group, terms are put into texts that have none, and the squares of the changes of
the score are penalised. So a group's name alone neither raises nor lowers a
score, whatever the labelled rows happen to say next to it.

The fit reads a bounded sample: at most ``MOST_LABELLED`` labelled rows, those of
least hash of their id among the rows to learn from (spread over all of them), and
one text of each id, that of least hash, however many rows repeat the id.
Features come from that sample by a likelihood-ratio test, those significant, and
of these the ``FEATURES`` with the highest ratio. The model is thus of bounded size and goes to the workers; every
whole text is scored in one pass without a shuffle.

Defined results: a null or empty text has the score of a text without features.
A null label is not learned from; of several labels of an id the highest counts.
With labels of one class only, all scores are the share of toxic rows, one of each
added; without labelled rows they are 0. Repeated rows get their score each. The
result has the rows of the table, null ids included. Identity terms are those of
English, German, French and Spanish.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import batch, in_turn, materialize, picked, slices, turn_to

MOST_LABELLED = 12_000
FEATURES = 6_000
#: Least log likelihood ratio of a feature (chance alone: about one in 50,000).
LEAST_RATIO = 9.0
FOLDS, HELD_OUT = 5, 0
#: Weight of the squared weights, and of the squared changes of the score.
RIDGE, FAIRNESS = 2e-4, 1.0
STEPS, RATE = 400, 0.1
CACHE = 200_000
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms by group; terms of a group are swapped for each other.
IDENTITY = (
    ("muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish", "polish"),
    ("disabled", "blind", "deaf", "autistic"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    ("old", "young", "elderly"),
    ("muslime", "juden", "christen", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwule", "lesben", "bisexuelle", "transgender"),
    ("deutsche", "türken", "polen", "russen", "franzosen", "amerikaner", "chinesen"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("musulmans", "juifs", "chrétiens", "hindous", "bouddhistes", "athées", "catholiques"),
    ("femmes", "hommes", "filles", "garçons"),
    ("gays", "lesbiennes", "bisexuels", "transgenres"),
    ("allemands", "turcs", "polonais", "russes", "français", "américains", "chinois"),
    ("immigrés", "réfugiés", "étrangers"),
    ("musulmanes", "judíos", "cristianos", "hindúes", "budistas", "ateos", "católicos"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("homosexuales", "lesbianas", "bisexuales", "transgénero"),
    ("alemanes", "turcos", "polacos", "rusos", "franceses", "americanos", "chinos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
_GROUP = {t: g for g in reversed(IDENTITY) for t in g}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    """bias, and the weight of each feature."""

    bias: float
    weights: dict[str, float]


class Scorer:
    def __init__(self, model: Model):
        self._model, self._number = model, {f: k for k, f in enumerate(model.weights)}
        self._weight = np.array([*model.weights.values()])
        self._of: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self._of) >= CACHE:
            self._of.clear()
        self._of[word] = own = tuple(self._number[f] for f in word_features(word) if f in self._number)
        return own

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        get = self._of.get
        for w in _words(text):
            own = get(w)
            found.update(self._learn(w) if own is None else own)
        at = self._model.bias + (self._weight[sorted(found)].sum() if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(at, -500, 500))))


_COUNTS = pa.schema([("feature", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            n[y].update({f for w in _words(text.as_py()) for f in word_features(w)})
        names = [*(n[0] | n[1])]
        yield batch({"feature": names, "n0": [n[0][f] for f in names], "n1": [n[1][f] for f in names]}, _COUNTS)


_ENCODED = pa.schema([("toxic", pa.int32()), ("own", pa.list_(pa.int32())), ("terms", pa.list_(pa.string()))])


def _encode(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            own, terms = [], []
            for text in b.column("text"):
                words = _words(text.as_py())
                own.append(sorted({number[f] for w in words for f in word_features(w) if f in number}))
                terms.append(sorted(words & _GROUP.keys()))
            yield batch({"toxic": b.column("toxic"), "own": own, "terms": terms}, _ENCODED)

    return run


def counterfactuals(own: list[int], terms: list[str], number: dict[str, int], nth: int) -> list[dict[int, int]]:
    """Changes of the features: each term swapped for the others of its group; in a text without terms, one is put in."""
    of = lambda t: {number[f] for f in word_features(t) if f in number}
    if not terms:
        group = IDENTITY[nth % len(IDENTITY)]
        return [dict.fromkeys(of(group[nth // len(IDENTITY) % len(group)]) - {*own}, 1)]
    out = []
    for t in terms:
        kept = set().union(*(of(x) for x in terms if x != t)) if len(terms) > 1 else set()
        for other in _GROUP[t]:
            if other != t:
                gone, new = of(t) - of(other) - kept, of(other) - {*own}
                out.append(dict.fromkeys(gone, -1) | dict.fromkeys(new, 1))
    return out


class _Rows:
    """A sparse matrix, row by row."""

    def __init__(self, rows: list[dict[int, int]], width: int):
        self.n, self._width = len(rows), width
        self._row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self._col = np.array([c for r in rows for c in r], np.int64)
        self._val = np.array([v for r in rows for v in r.values()], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self._row, self._val * w[self._col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self._col, self._val * r[self._row], self._width)


def fit(labels: list[int], own: list[list[int]], swaps: list[dict[int, int]], width: int) -> tuple[float, np.ndarray]:
    """Logistic loss, plus RIDGE * |w|^2 / 2, plus FAIRNESS * mean squared change of the score / 2, by Adam's method."""
    x, d, y = _Rows([dict.fromkeys(r, 1) for r in own], width), _Rows(swaps, width), np.array(labels, float)
    w, b = np.zeros(width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        r = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -500, 500))) - y) / len(y)
        g = np.r_[x.back(r) + RIDGE * w + (FAIRNESS / d.n * d.back(d.times(w)) if d.n else 0), r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return b, w


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """docs: doc_id, text. labels: doc_id, toxic; only rows to learn from."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows of 12 bytes
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("h").alias("h"))
    sample = texts.join(F.broadcast(one), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = materialize(sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")
    n = dict(sample.groupBy("toxic").count().collect())
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(float(np.log((n1 + 1) / (n0 + 1))), {}) if n0 or n1 else None
    counts = sample.mapInArrow(in_turn(forget, _count), "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    part = lambda a, total: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / ((F.col("n0") + F.col("n1")) * total / (n0 + n1)))).otherwise(0.0)
    ratio = part("n0", n0) + part("n1", n1)
    best = counts.where(ratio >= LEAST_RATIO).orderBy(ratio.desc(), "feature").limit(FEATURES)
    names = sorted({r[0] for r in best.collect()} | {f for t in _GROUP for f in word_features(t)})
    number = {f: k for k, f in enumerate(names)}
    rows = sample.mapInArrow(in_turn(forget, _encode(number)), "toxic int, own array<int>, terms array<string>").collect()  # at most `most` rows
    swaps = [s for k, r in enumerate(rows) for s in counterfactuals(r["own"], r["terms"], number, k) if s]
    bias, w = fit([r["toxic"] for r in rows], [r["own"] for r in rows], swaps, len(names))
    return Model(bias, {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6})


def forget() -> None:
    """Nothing outlives a task: a scorer's words go with it."""


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs, with all its columns, and score (double); a column of that name is replaced."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at: dict[int, Scorer] = {}

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if 0 not in at:
            turn_to(forget)
            at[0] = Scorer(shared.value)
        return pa.array([at[0].score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("score", scored(F.col(f"`{text_col}`").cast("string")))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with score, learned from labels outside the held-out fold; learn_from: the labelled texts, if not docs."""
    known = picked(learn_from if learn_from is not None else docs, doc_id="doc_id", text="text")
    rows = picked(labels, doc_id="doc_id", toxic="toxic").where(fold() != HELD_OUT)
    return score(docs, train(known, rows, most))
