"""Quality classifier: a generalised additive model with pairwise interactions over text features.

Each feature is cut into quantile bins. Training boosts cyclically: in every round each feature in turn gets a
shallow tree fitted to the current gradients of its bins and added, shrunk, to that feature's lookup table.
Then the pairs whose coarse two-way tables explain most of what is left get tables of their own, boosted by
two-level trees in the same cyclic way. A text's score is the logistic of the intercept plus one table entry
for each feature and pair: additions of looked-up bins, vectorised over rows.

Features are computed on the executors, over whole texts. Only the features of a bounded sample of labelled
rows (TRAIN_ROWS) come to the driver, where the tables are fitted.

Defined results: null and empty texts have the features of a text without words and are scored like any other.
With no labelled row, or one class only, every score is that class's share (0.5 without any). A label that stands
several times for one document counts once, and a labelled doc_id with several texts teaches by the least of them. Very long
texts are read whole. An empty table gives an empty result. Extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices, strings, table

#: Expected number of labelled rows that the model is fitted on; a hash sample if there are more.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
#: Added to a bin's weight, so that bins with few rows move little.
RIDGE = 2.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "punctuation", "symbol", "pipe", "exclamation",
    "non_ascii", "distinct_words", "same_as_before", "commonest_word", "distinct_lines", "words_a_line", "stops", "longest_word",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"?()-", b"#*$%&<>@^~=+\\/{}[]_", b"|", b"!", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".?")] = True


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=histogram, minlength=10) / n
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=len(words))
    counts = np.bincount(ids) if len(ids) else np.zeros(1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, *share[1:].tolist(),
        len(number) / w, float((ids[1:] == ids[:-1]).sum()) / w, float(counts.max()) / w, len(set(lines)) / len(lines), w / len(lines), float(histogram[_STOPS].sum()) / w, float(max(map(len, words), default=0)),
    ]


def with_features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Result: keep..., features array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            found = [features(t) for t in strings(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    part = df.select(*keep, F.col(text).cast("string").alias("text to read"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField("features", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature's bins
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin of each feature
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        z = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The best cut of ordered bins into two leaves: first bin of the second leaf, and the gain."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return k + 1, float(gain[k])


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins, as its value in each bin."""
    k, gain = _cut(g, h) if depth else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over a two-way table: cut along one axis, then each side along the other."""
    best, gain_best = None, -1.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        k, gain = _cut(a.sum(1), b.sum(1))
        halves = [(a[:k], b[:k]), (a[k:], b[k:])]
        sides = [_cut(x.sum(0), y.sum(0)) if len(x) else (0, 0.0) for x, y in halves]
        if (total := gain + sides[0][1] + sides[1][1]) > gain_best:
            out = np.zeros(a.shape)
            for rows, (x, y), (m, _) in zip((slice(None, k), slice(k, None)), halves, sides, strict=True):
                if len(x):
                    out[rows, :m], out[rows, m:] = _leaf(x[:, :m], y[:, :m]) if m else 0.0, _leaf(x[:, m:], y[:, m:])
            best, gain_best = out if axis == 0 else out.T, total
    return best


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a bounded sample; the same rows in the same order give the same tables."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))))
    model = Model(float(np.log(share / (1 - share))))
    z, bins = np.full(len(y), model.intercept), []
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
        bins.append(np.searchsorted(model.edges[j], x[:, j], side="right"))
        model.tables.append(np.zeros(len(model.edges[j]) + 1))
        model.coarse.append(np.arange(len(model.tables[j])) * PAIR_BINS // len(model.tables[j]))
    sums = lambda at, size, v: np.bincount(at, weights=v, minlength=size)
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(sums(b, len(t), y - p), sums(b, len(t), p * (1 - p)))
            t += step
            z += step[b]
    p = 1 / (1 + np.exp(-z))
    size, found = PAIR_BINS * PAIR_BINS, []
    at = lambda i, j: model.coarse[i][bins[i]] * PAIR_BINS + model.coarse[j][bins[j]]
    for i in range(x.shape[1]):
        for j in range(i):
            g, h = sums(at(j, i), size, y - p), sums(at(j, i), size, p * (1 - p))
            found.append((-float((g**2 / (h + RIDGE)).sum()), j, i))
    chosen = [(i, j) for _, i, j in sorted(found)[:PAIRS]]
    grids = [np.zeros(size) for _ in chosen]
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in zip(chosen, grids, strict=True):
            p, k = 1 / (1 + np.exp(-z)), at(i, j)
            step = RATE * _pair_tree(sums(k, size, y - p).reshape(PAIR_BINS, -1), sums(k, size, p * (1 - p)).reshape(PAIR_BINS, -1)).ravel()
            grid += step
            z += step[k]
    model.pairs = [(i, j, grid.reshape(PAIR_BINS, -1)) for (i, j), grid in zip(chosen, grids, strict=True)]
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fits on labelled documents: about TRAIN_ROWS of them by hash of the key, all if there are fewer."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias(key), F.col(label).cast("int").alias("y")).distinct()
    n = named.count()
    if n > TRAIN_ROWS:
        named = named.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * TRAIN_ROWS / n))
    rows = docs.select(key, text).join(F.broadcast(named), key).groupBy(key, "y").agg(F.min(text).alias(text))  # at most about TRAIN_ROWS pairs of numbers
    got = with_features(rows, text, (key, "y")).toPandas().sort_values([key, "y"])
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort([*x.T])
    return fit_arrays(x[order], (got["y"].to_numpy()[order] > 0).astype(float))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Result: keep..., score double: higher where label 1 is likelier."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # some kilobytes of tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            x = np.array([features(t) for t in strings(batch.column(len(keep)))], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shipped.value.score(x))], [*keep, "score"])

    part = df.select(*keep, F.col(text).cast("string").alias("text to read"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())]))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's score; labels of held-out documents don't teach."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
