"""Toxicity grades by cumulative-link (proportional odds) regression on sparse word frequencies.

P(grade > k) = sigmoid(w.x - cut[k]) with one weight vector w for all ordered cuts; x is how often each
word occurs in SPAN words, so that a long text is no more toxic than a short one like it. Labels say toxic
or not. The severity of toxic training documents comes from two models of that alone, each fitted on half
of the documents and applied to the other: among toxic documents of like length, the third with the
lowest scores has grade 1, the next 2, the highest 3. The final model is fitted to these grades on a bounded
sample of labelled rows; everything is scored. McCullagh, "Regression Models for Ordinal Data" (1980).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import ship, slices, uniform

#: Labelled rows that are fitted, of each class; a labelled text of more characters is not fitted (all are scored).
PER_CLASS, MOST_CHARS = 4000, 20_000
#: Words that are features: so many at most, in so many training documents, with so many standard errors of log odds between the classes.
FEATURES, LEAST_DOCS, LEAST_Z, GRADES = 3000, 3, 3.0, 4
#: Probability of being toxic from which a document is rejected: a missed toxic one weighs three times a lost clean one.
REJECT = 0.25
#: Words that frequencies refer to; words that are added to a text's own, for short texts; toxic documents of like length.
SPAN, EXTRA, PEERS = 50.0, 90, 30
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """How often each word (letters only, lower case) occurs."""
    return Counter(_LETTERS.findall(text.lower())) if text else Counter()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: dict[str, float]
    cuts: np.ndarray

    def score(self, text: str | None) -> float:
        counts = features(text)
        return SPAN / (sum(counts.values()) + EXTRA) * sum(self.weights[w] * counts[w] for w in self.weights.keys() & counts.keys())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k."""
        return _sigmoid(scores[:, None] - self.cuts[None, :])


class Bags:
    """Documents as sparse rows of word frequencies."""

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        words, times, sizes = [np.empty(0, np.int64)], [np.empty(0)], []
        for text in texts:
            counts = features(text)
            sizes.append((len(counts), sum(counts.values())))
            words.append(np.array([number.setdefault(w, len(number)) for w in counts], np.int64))
            times.append(np.array(list(counts.values()), float))
        distinct, self.length = np.array(sizes, np.int64).reshape(-1, 2).T
        self.words, self.n = list(number), len(sizes)
        self.rows, self.cols = np.repeat(np.arange(self.n), distinct), np.concatenate(words)
        self.values = np.concatenate(times) * (SPAN / (self.length + EXTRA))[self.rows]

    def chosen(self, toxic: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Words that tell the classes of some documents apart: the clearest first, at most FEATURES."""
        n, used = np.array([(~toxic & among).sum(), (toxic & among).sum()], float), among[self.rows]
        seen = np.stack([np.bincount(self.cols[used & (toxic[self.rows] == t)], minlength=len(self.words)) for t in (False, True)], axis=1)
        odds = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
        power = np.abs(odds) / np.sqrt((1 / (seen + 0.5)).sum(axis=1))
        fit_for = np.flatnonzero((seen.sum(axis=1) >= LEAST_DOCS) & (power >= LEAST_Z))
        return np.array(sorted(fit_for.tolist(), key=lambda k: (-power[k], self.words[k]))[:FEATURES], np.int64)


def objective(theta: np.ndarray, x: tuple[np.ndarray, np.ndarray, np.ndarray], grade: np.ndarray, weight: np.ndarray, grades: int, decay: float) -> tuple[float, np.ndarray]:
    """The penalised negative log likelihood and its gradient; theta: word weights, the first cut, logs of the distances to the next ones."""
    (rows, cols, values), n = x, len(theta) - grades + 1
    w, free = theta[:n], theta[n:]
    steps = np.concatenate([free[:1], np.exp(free[1:])])
    cuts, score = np.cumsum(steps), np.bincount(rows, values * w[cols], minlength=len(grade))
    low, high = np.concatenate([[-np.inf], cuts])[grade], np.concatenate([cuts, [np.inf]])[grade]
    a, b = _sigmoid(high - score), _sigmoid(low - score)
    p = np.maximum(a - b, 1e-12)
    da, db = a * (1 - a) / p, b * (1 - b) / p
    g_score, g_cut = weight * (da - db), np.zeros(grades - 1)
    np.add.at(g_cut, grade[grade < grades - 1], -(weight * da)[grade < grades - 1])
    np.add.at(g_cut, grade[grade > 0] - 1, (weight * db)[grade > 0])
    tail = np.cumsum(g_cut[::-1])[::-1] * np.concatenate([[1], steps[1:]])
    gradient = np.concatenate([np.bincount(cols, g_score[rows] * values, minlength=n) + decay * w, tail])
    return float(-(weight * np.log(p)).sum() + decay * (w @ w) / 2), gradient


def _solve(bags: Bags, words: np.ndarray, among: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Word weights and cuts that fit the grades of some documents (Adam, from zero)."""
    column = np.full(len(bags.words), -1, np.int64)
    column[words] = np.arange(len(words))
    place = np.cumsum(among) - 1
    used = among[bags.rows] & (column[bags.cols] >= 0)
    x = place[bags.rows[used]], column[bags.cols[used]], bags.values[used]
    theta = np.zeros(len(words) + grades - 1)
    theta[len(words)] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = objective(theta, x, grade[among], weight[among], grades, decay / len(grade))[1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    free = theta[len(words) :]
    return theta[: len(words)], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _thirds(score: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Grades 1 to 3 by the rank of the score among documents of like length: PEERS of them, next to each other by length."""
    by_length, out = np.lexsort((score, length)), np.empty(len(score), np.int64)
    for peers in np.array_split(by_length, max(1, len(score) // PEERS)):
        order = peers[np.argsort(score[peers], kind="stable")]
        out[order] = 1 + np.arange(len(order)) * (GRADES - 1) // len(order)
    return out


def fit(texts: Iterable[str], toxic: list[int], shares: tuple[float, float], steps: int = 300, decay: float = 0.02) -> Model | None:
    """shares: what part of all labelled rows is not toxic and toxic, which weighs the two samples. None without both classes."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    bags, halves, severity = Bags(texts), np.arange(len(y)) % 2 == 0, np.zeros(len(y))
    weight = np.array(shares)[y.astype(int)] / np.array([(~y).sum(), y.sum()])[y.astype(int)]
    for half in (halves, ~halves):
        if y[half].any() and not y[half].all():
            words = bags.chosen(y, half)
            w = np.zeros(len(bags.words))
            w[words] = _solve(bags, words, half, y.astype(int), weight, 2, steps, decay)[0]
            score = np.bincount(bags.rows, bags.values * w[bags.cols], minlength=bags.n)
            severity[~half] = (score - score[half].mean())[~half] / max(score[half].std(), 1e-9)
    grade, every = np.zeros(len(y), np.int64), np.ones(len(y), bool)
    grade[y] = _thirds(severity[y], bags.length[y])
    words = bags.chosen(y, every)
    w, cuts = _solve(bags, words, every, grade, weight, GRADES, steps, decay)
    return Model({bags.words[k]: float(v) for k, v in zip(words, w) if abs(v) > 1e-4}, cuts)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """The model from at most per_class labelled documents of each class, always the same ones.

    Labels other than 0 and 1, labels and documents without an id, and null or very long texts (MOST_CHARS)
    are not fitted; of repeated labels the highest counts, of documents of one id the smallest text.
    None, if what is left, as with empty tables, has not both classes.
    """
    known = labels.where(F.col(toxic_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled"), F.col(toxic_col).alias("toxic")).groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    total = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    picked = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).orderBy(uniform(F.col("labelled"), F.lit(6)), "labelled").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= MOST_CHARS)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most 2 * per_class rows: a bounded broadcast; a repeated document counts once
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    whole = max(1, sum(total.values()))
    return _fitted(found, (total.get(0, 0) / whole, total.get(1, 0) / whole))


def _fitted(sample: DataFrame, shares: tuple[float, float]) -> Model | None:
    """fit() of the rows (doc_id, text, toxic), in the order of the ids, by one task: the driver gets the model, but no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        model = fit((t.as_py() for batch in held for t in batch.column("text")), [t for batch in held for t in batch.column("toxic").to_pylist()], shares)
        if model is not None:
            columns = [pa.array([list(model.weights)], pa.list_(pa.string())), pa.array([list(model.weights.values())], pa.list_(pa.float64())), pa.array([model.cuts.tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["words", "weights", "cuts"])

    rows = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")
    found = rows.mapInArrow(run, "words array<string>, weights array<double>, cuts array<double>").collect()
    return Model(dict(zip(found[0]["words"], found[0]["weights"])), np.array(found[0]["cuts"])) if found else None


def grade(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, rejected) for every row.

    severity is the expected grade, 0 to 3; p_toxic is P(grade > 0), and rejected whether that reaches the
    limit; grade is 0 where it does not, else 1 and one more for each further cut that is likelier passed than
    not. A null or empty text has no words and gets the model's base rate. Without a model (no labels of both
    classes) all is 0 and nothing is rejected. Repeated rows stay repeated. An empty table gives an empty one.
    """
    get = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped = get()
        for batch in slices(batches, "text"):
            above = _above(shipped, batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(np.where(above[:, 0] >= reject, 1 + (above[:, 1:] >= 0.5).sum(axis=1), 0).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= reject)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "grade", "p_toxic", "rejected"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double, rejected boolean")


def _above(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros((len(texts), GRADES - 1))
    return model.above(np.array([model.score(t.as_py()) for t in texts], float))


def drop(docs: DataFrame, model: Model | None, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without the rows that grade() rejects; the others as they are, with all columns.

    A null or empty text gets the model's base rate; without a model all rows stay. Repeated rows are judged
    alike. An empty table gives an empty one.
    """
    get = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped = get()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(_above(shipped, batch.column(text_col))[:, 0] < reject))

    return docs.mapInArrow(run, docs.schema)
