"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text (shares of character classes, repetition of words, pairs and
lines, shape of lines). Trees grow level by level on histograms of binned statistics, with numpy on the
driver, from a bounded sample of labelled rows (``TRAIN_ROWS``, the smallest hashes of ids). The trained forest is
flattened into arrays, complete trees side by side, and a batch of documents goes down all trees at once.

Cases: a null text counts as empty, and empty texts are scored like any other; labels that are null are left out;
without labels of both kinds every score is the share of label 1 (0.5 without any labels); repeated rows are
scored each; very long texts are read whole; ids with one hash go by id into the sample; an empty table gives an empty result;
extra columns don't matter, as only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_of

#: The bound of the sample of labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
PREDICT_AT = 0.3

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bar", "symbol", "lead", "rest", "control")
_CLASS_OF = np.full(256, _CLASSES.index("symbol"), np.uint8)
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
_CLASS_OF[:32] = 10
_CLASS_OF[[32, 9]] = 3
_CLASS_OF[[10, 13]] = 4
_CLASS_OF[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS_OF[ord("|")] = 6
_CLASS_OF[0xC0:] = 8
_CLASS_OF[0x80:0xC0] = 9

FEATURES = (
    *(f"share_{c}" for c in _CLASSES if c not in ("rest", "newline")), "log_words", "log_lines", "word_mean", "word_sd", "word_max",
    "distinct_words", "top_word", "same_neighbours", "distinct_pairs", "distinct_lines", "line_mean", "line_max", "ends_in_stop", "line_starts_upper",
    "worst_symbol", "worst_upper", "worst_bar", "bytes_symbol", "bytes_upper", "bytes_bar", "short_words",
)


def statistics(text: bytes) -> np.ndarray:
    """The statistics named in ``FEATURES`` of one UTF-8 text."""
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    cls = _CLASS_OF[np.frombuffer(text, np.uint8)]
    count = np.bincount(cls, minlength=len(_CLASSES)).astype(np.float64)
    chars = max(1.0, len(text) - count[9])
    shares = [count[i] / chars for i, c in enumerate(_CLASSES) if c not in ("rest", "newline")]
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    if n:
        size = np.fromiter(map(len, words), np.float64, n)
        tally = Counter(words)
        pairs = set(zip(words, words[1:], strict=False))
        of_words = [size.mean(), size.std(), size.max(), len(tally) / n, max(tally.values()) / n, sum(map(eq, words, words[1:])) / n, len(pairs) / max(1, n - 1)]
        short = float((size <= 2).mean())
    else:
        of_words, short = [0.0] * 7, 0.0
    line_size = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    begin = np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10)))
    width = np.diff(np.concatenate((begin, [len(text)])))
    worst, held = [], []
    for k in (7, 1, 6):  # symbols, capitals, bars: the worst line, and the share of bytes in lines full of them
        share = np.add.reduceat(cls == k, begin, dtype=np.int64) / np.maximum(width, 1)
        long = width >= 24
        worst.append(float(share[long].max()) if long.any() else float(share.max()))
        held.append(float(width[share > (0.4 if k == 1 else 0.06)].sum() / len(text)))
    out[:] = [
        *shares, np.log1p(n), np.log1p(len(lines)), *of_words, len(set(lines)) / m, line_size.mean(), line_size.max(),
        sum(x[-1:] in b".!?" for x in lines) / m, sum(x[:1].isupper() for x in lines) / m, *worst, *held, short,
    ]
    return out


class Forest:
    """Complete trees of one depth, flattened: feature and cut per inner node, value per leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def logits(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        depth = (inner + 1).bit_length() - 1
        out = np.empty(len(x))
        tree = np.arange(trees)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.cut[tree, node])
            out[a : a + 1024] = self.base + self.value[tree, node - inner].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.logits(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Forest:
    """Boost trees on the logistic loss; every level's splits come from one histogram of gradients."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cell = np.arange(d)[None, :] * bins + binned
    f = np.full(n, base)
    feature, cut_at, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            at = ((node - (width - 1)) * (d * bins))[:, None] + cell
            sums = [np.bincount(at.ravel(), np.repeat(w, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2) for w in (g, h)]
            gl, hl = (s[:, :, :-1] for s in sums)
            gt, ht = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins - 1)
                if flat[k, best[k]] > 1e-6 and b < len(edges[j]):
                    feature[t, width - 1 + k], cut_at[t, width - 1 + k] = j, edges[j][b]
            j = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), j] > cut_at[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = -rate * gs / (hs + l2)
        f += value[t, leaf]
    return Forest(base, feature, cut_at, value)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, in_fold, rows: int) -> DataFrame:
    """text and label of a bounded sample: the ``rows`` labelled ids with the smallest hashes, of those in the fold."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_fold).select("doc_id", F.col(label).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", text_of().cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """A forest for ``labels.quality``, from rows outside the held-out fold."""
    sample = training_rows(docs, labels, "quality", fold_of("doc_id", FOLDS) != HELD_OUT, rows)

    @F.pandas_udf("array<float>")
    def stats(text: pd.Series) -> pd.Series:
        return text.map(lambda t: statistics(bytes(t)))

    got = sample.select("doc_id", "label", stats("text").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(rows).toPandas()
    x = np.stack(got["x"].to_list()).astype(np.float32) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, got["label"].to_numpy(np.float64))


def score_column(model: Forest):
    """A function from a column of UTF-8 texts (binary) to their scores."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.stack([statistics(bytes(t)) for t in text])))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    score = score_column(train(docs, labels))
    out = docs.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score(text_of().cast("binary")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
