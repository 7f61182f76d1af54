"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words and word beginnings that a text has, and over those of them that make up a fiftieth of it,
trained from confirmed toxic documents (P) and unlabelled text (U) under the class-prior-corrected risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` (Kiryo and others, 2017) with the sigmoid loss and a ridge. Labels 0
are not examples; they only count towards the class prior.

P is a bounded sample of labelled rows (``POSITIVES``, the smallest hashes of ids in the training folds; texts with the same
words count once). U is every document of the training folds. Candidates are the features that significantly more
positives than unlabelled texts would have even if no unlabelled text had them, so none that could be chosen is left out.
How many unlabelled texts have each is counted over all of U, those that really tell are the features, and texts are read
once more, into the marks they have. Texts of U with the same marks are one row with a number. The risk is minimised by L-BFGS with
one pass over these rows per step, of which a vector of partial sums comes back; on the driver are P's features, a few numbers per
candidate, and the weights.

Cases: a null text counts as empty; a text without words scores as the bias alone (clean); without toxic examples
every score is 0; null labels are left out; repeated rows are scored each; very long texts are read whole; ties of hashes go by
id; an empty table gives an empty result; only ids, texts and labels are read, and a filter keeps extra columns whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, text_of, without
from .quality import training_rows

#: Bound of the sample of labelled toxic rows that the classifier is fitted on.
POSITIVES = 3000
#: Positives that a feature is in at least, and the least log-likelihood ratio of its share of P against that of U: for significance, and per positive, for effect.
LEAST_POSITIVES, LEAST_RATIO, RATIO_EACH = 3, 6.0, 0.02
FOLDS, HELD_OUT = 4, 2
PREDICT_AT = 0.3
#: A feature is frequent in a text if one word in so many has it.
FREQUENT = 50
#: Weight of the ridge, and the most steps of the fit.
RIDGE, STEPS = 3e-6, 20
BEGINNINGS = range(3, 8)
_BREAK = re.compile(r"[\W_]+")
#: Words whose features a worker keeps.
KEPT_WORDS = 120_000
#: Patterns of marks that a task of a pass sums up at least, where there are more tasks than cores.
PATTERNS_EACH = 20_000
#: Texts of the positives whose features are spread out at once.
TEXTS_AT_ONCE = 64


def words_of(text: str) -> list[str]:
    return [w for w in _BREAK.split(text.lower()) if w]


def features_of(word: str) -> list[str]:
    """A word's beginnings of 3 to 7 letters, and the word itself, which a blank at its end tells from a beginning."""
    return [*(word[:k] for k in BEGINNINGS if len(word) >= k), f"{word} "]


class Marks:
    """Which of some features a text has: places in ``keys``, doubled, and one more where it is frequent.

    What stands between blanks is looked up as a whole: how many words it has, and their features. ``nested``: with a feature of
    a word, ``keys`` have all shorter beginnings of it, so a word's search ends at the first one that isn't there.
    """

    def __init__(self, keys: list[str], nested: bool = False):
        self.keys, self.nested = keys, nested
        self.place = {k: i for i, k in enumerate(keys)}
        self._known: dict[str, tuple[int, tuple[int, ...]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def _look(self, piece: str) -> tuple[int, tuple[int, ...]]:
        if len(self._known) > KEPT_WORDS:
            self._known.clear()
        words, place, out = [piece] if piece.isalnum() else words_of(piece), self.place, []
        for w in words:
            for k in features_of(w):
                if k in place:
                    out.append(place[k])
                elif self.nested:
                    break
        own = self._known[piece] = len(words), tuple(out)
        return own

    def present(self, text: str) -> set[int]:
        """Places of the features that the text has."""
        known, out = self._known, set()
        for piece in set(text.lower().split()):
            own = known.get(piece) or self._look(piece)
            if own[1]:
                out.update(own[1])
        return out

    def of(self, text: str) -> list[int]:
        known, tally, total = self._known, {}, 0
        for piece, n in Counter(text.lower().split()).items():
            words, own = known.get(piece) or self._look(piece)
            total += n * words
            for i in own:
                tally[i] = tally.get(i, 0) + n
        return sorted([2 * i for i in tally] + [2 * i + 1 for i, n in tally.items() if n * FREQUENT >= total])


class Linear:
    """Bias and the weights of marks."""

    def __init__(self, bias: float, keys: list[str], weights: np.ndarray):
        self.bias, self.weights, self.marks = bias, weights, Marks(keys)

    def score(self, text: str) -> float:
        return self.score_of(self.marks.of(text))

    def score_of(self, marks: list[int]) -> float:
        z = self.bias + float(self.weights[marks].sum())
        return float(1.0 / (1.0 + np.exp(-min(max(z, -700.0), 700.0))))


# --- the risk ----------------------------------------------------------------------------------------

#: Texts as marks: where each begins, the marks, and how many texts each stands for.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(lists: list[np.ndarray], count: np.ndarray | None = None) -> Rows:
    begin = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return begin, np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.ones(len(lists)) if count is None else count


def loss_sums(rows: Rows, theta: np.ndarray, sign: int) -> np.ndarray:
    """Sum of the sigmoid losses of texts as if each were of class ``sign``, then the gradient (weights, bias)."""
    begin, mark, count = rows
    n = len(begin) - 1
    row = np.repeat(np.arange(n), np.diff(begin))
    z = np.bincount(row, theta[mark], n) + theta[-1]
    loss = 1 / (1 + np.exp(np.clip(sign * z, -60, 60)))
    slope = -sign * count * loss * (1 - loss)
    grad = np.bincount(mark, slope[row], len(theta) - 1)
    return np.concatenate(([float((count * loss).sum())], grad, [slope.sum()]))


def nn_risk(theta: np.ndarray, p: Rows, negative: np.ndarray, n_u: float, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with its ridge, and its gradient. ``negative``: ``loss_sums`` of U as if it were clean."""
    n_p = p[2].sum()
    positive, as_clean = loss_sums(p, theta, 1) * prior / n_p, loss_sums(p, theta, -1) * prior / n_p
    rest = negative / n_u - as_clean
    ridge = np.append(theta[:-1], 0.0)
    total = positive + (rest if rest[0] > 0 else 0.0)
    return float(total[0] + RIDGE / 2 * (ridge @ ridge)), total[1:] + RIDGE * ridge


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, grad = f(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1e-12, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        down, t = float(q @ grad), 1.0
        for _ in range(12):
            new = theta - t * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * t * down:
                break
            t /= 4
        else:
            break
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        gain, theta, value, grad = value - new_value, new, new_value, new_grad
        if gain <= 1e-6 * abs(value) or np.abs(grad).max() < 1e-7:
            break
    return theta


# --- passes over tables ------------------------------------------------------------------------------


def _with_marks(rows: DataFrame, marks: Marks) -> DataFrame:
    """``rows`` with marks (array of places) in the place of text."""

    @F.pandas_udf("array<int>")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([np.array(marks.of(t), np.int32) for t in text], dtype=object)

    return rows.withColumn("marks", of("text")).drop("text")


def _counted(rows: DataFrame, marks: Marks) -> np.ndarray:
    """How many of the texts have each feature: counts per partition are what leaves the executors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(marks.place), np.int64)
        for b in batches:
            for t in b.column("text"):
                total[list(marks.present(t.as_py()))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = rows.select("text").mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(marks.place))
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _positive_features(toxic: DataFrame) -> DataFrame:
    """words (one value per set of words) and keys (all features) of the positives; texts with the same words are one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            keys, sign = [], []
            for t in b.column("text"):
                words = set(words_of(t.as_py()))
                sign.append(xxhash.xxh64_intdigest(" ".join(sorted(words)).encode()) - 2**63)
                keys.append(sorted({k for w in words for k in features_of(w)}))
            yield pa.RecordBatch.from_arrays([pa.array(sign, pa.int64()), pa.array(keys, pa.list_(pa.string()))], ["words", "keys"])

    rows = toxic.select(F.col("text").cast("string").alias("text")).mapInArrow(of, "words long, keys array<string>")
    return cut(rows.groupBy("words").agg(F.first("keys").alias("keys")))


def _ratio(in_p: np.ndarray, n_p: float, in_u: np.ndarray, n_u: float) -> np.ndarray:
    """Log-likelihood ratio of features that more of P than of U have; 0 for others."""
    a, b = in_p.astype(float), in_u.astype(float)
    both = (a + b) / max(1, n_p + n_u)
    term = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    ratio = term(a, n_p * both) + term(b, n_u * both) + term(n_p - a, n_p * (1 - both)) + term(n_u - b, n_u * (1 - both))
    return np.where(a * n_u > b * n_p, ratio, 0.0)


def in_few_tasks(patterns: DataFrame) -> DataFrame:
    """``patterns`` (cut) in as many tasks as their number asks for: every task of a pass gives a sum per mark, however few patterns it has read."""
    context = patterns.sparkSession.sparkContext
    return patterns.coalesce(max(context.defaultParallelism, patterns.count() // PATTERNS_EACH))


def _negative_sums(patterns: DataFrame, theta: np.ndarray) -> np.ndarray:
    """``loss_sums`` of all ``patterns`` (marks, n) as if they were clean: partial sums on the executors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(theta) + 1)
        for b in batches:
            lists = b.column("marks")
            begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            total += loss_sums((begin, lists.flatten().to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False).astype(float)), theta, -1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    got = patterns.mapInArrow(of, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(theta) + 1)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES) -> tuple[Linear, DataFrame]:
    """A classifier from the training folds, and all documents as (doc_id, held_out, marks) of its marks.

    ``prior``: share of toxic documents; None takes that of the folds' labels.
    """
    fold = fold_of("doc_id", FOLDS) != HELD_OUT
    rows = docs.select("doc_id", (~fold).alias("held_out"), text_of().alias("text"))
    if prior is None:
        share = labels.where(fold).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(0.9, max(0.005, share or 0.0))
    toxic = _positive_features(training_rows(docs, labels.where("toxic = 1"), "toxic", fold, positives))
    n_p = toxic.count()
    if not n_p:
        return Linear(-700.0, [], np.zeros(0)), _with_marks(rows, Marks([]))
    n_u = float(docs.where(fold).count())
    often = toxic.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_POSITIVES).toArrow()
    keys, in_p = np.array(often.column("key").to_pylist(), object), often.column("n").to_numpy()
    # The ratio without unlabelled texts grows with in_p, and a beginning is in no fewer positives than what goes on from it: candidates are nested.
    could = np.flatnonzero(_ratio(in_p, n_p, np.zeros(len(keys)), n_u) >= LEAST_RATIO + RATIO_EACH * n_p)
    could = could[np.argsort(keys[could])]
    keys, in_p = keys[could], in_p[could]
    in_u = _counted(rows.where(~F.col("held_out")), Marks(keys.tolist(), nested=True))
    chosen = keys[_ratio(in_p, n_p, in_u, n_u) >= LEAST_RATIO + RATIO_EACH * n_p].tolist()
    model = Marks(chosen)
    marked = cut(_with_marks(rows, model))
    if not len(chosen):
        return Linear(float(np.log(prior / (1 - prior))), [], np.zeros(0)), marked
    patterns = in_few_tasks(cut(marked.where(~F.col("held_out")).groupBy("marks").agg(F.count(F.lit(1)).alias("n"))))
    texts = training_rows(docs, labels.where("toxic = 1"), "toxic", fold, positives).select("doc_id", F.col("text").cast("string").alias("text"))
    p = _with_marks(texts, model).groupBy("doc_id", "marks").count().select("marks").toArrow().column("marks")  # at most ``positives`` rows
    p = packed([np.array(x.as_py(), np.int64) for x in p])
    start = np.append(np.zeros(2 * len(chosen)), np.log(prior / (1 - prior)))
    theta = minimise(lambda t: nn_risk(t, p, _negative_sums(patterns, t), n_u, prior), start)
    return Linear(float(theta[-1]), chosen, theta[:-1]), marked


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model, marked = train(docs, labels)

    @F.pandas_udf("double")
    def score(marks: pd.Series) -> pd.Series:
        return pd.Series([model.score_of(np.asarray(m, np.int64)) for m in marks], dtype="float64")

    out = marked.select("doc_id", "held_out", score("marks").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""
    model, _ = train(docs, labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    (name,) = without(docs.columns, "score")
    return docs.withColumn(name, score(text_of())).where(F.col(name) < PREDICT_AT).select(*docs.columns)
