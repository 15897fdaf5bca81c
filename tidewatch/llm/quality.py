"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a table of bins. Boosting goes round the features again and again and adds a shallow
tree over one feature's bins to that feature's table; then the pairs of features that explain most of
what is left get small two-way tables in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, release, slices, table

#: The model is fitted on so many labelled rows at most, those with the smallest hash of the id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 10, 150, 60, 0.15

FEATURES = ["log_bytes", "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "punctuation", "exclamations", "symbols", "non_ascii", "repeated_lines", "words_a_line", "ends", "repeats", "longest_word", "short_words", "entropy", "capitals", "long_words"]


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all 0 for a null or empty one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    punct = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    p = hist[hist > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        float(sizes.mean()),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        upper / max(1, upper + lower),
        int(hist[48:58].sum()) / n,
        punct / n,
        int(hist[33]) / n,
        int(hist[35:39].sum() + hist[64] + hist[94:97].sum() + hist[123:127].sum()) / n,
        int(hist[128:].sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        int(hist[46] + hist[63]) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        np.log1p(int(sizes.max())),
        float((sizes <= 3).mean()),
        float(-(p * np.log2(p)).sum()),
        sum(x[0].isupper() for x in counts) / max(1, len(counts)),
        float((sizes >= 12).mean()),
    ]


@dataclass
class Model:
    """Bin edges and tables of each feature, two-way tables of the chosen pairs, and the base value."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over one feature's bins, as a value for each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, at, k = max(((*_split(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)), default=(0.0, 0, 0))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of the first feature, then one of the second on either side: four leaves over a grid."""
    gain, at = _split(g.sum(1), h.sum(1))
    out = np.zeros(g.shape)
    for rows in (slice(0, at), slice(at, g.shape[0])):
        gg, hh = g[rows].sum(0), h[rows].sum(0)
        more, cut = _split(gg, hh)
        gain += max(0.0, more)
        for cols in (slice(0, cut), slice(cut, g.shape[1])):
            if gg[cols].size:
                out[rows, cols] = gg[cols].sum() / (hh[cols].sum() + 1)
    return gain, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on rows of features and labels 0 or 1; with one class only, its smoothed rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, at in enumerate(fine):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size))
            model.tables[j] += step
            total += step[at]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -_pair_tree(*sums(*ab)[:2])[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h, cell = sums(a, b)
            step = RATE * _pair_tree(g, h)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that are not held out; rows without a label do not count."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    chosen = chosen.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "doc_id"])

    # At most `rows` ids and labels are broadcast, so texts need no shuffle.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id").mapInArrow(describe, "x array<double>, label int, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    model = fit(x, (got["label"].to_numpy() == 1).astype(np.float64))
    del got, x
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with held_out, score and predicted added; columns of these names are replaced.

    A null text counts as empty. Repeated rows get equal scores.
    """
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            s = model.scores(x)
            out = [pa.array([is_held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*names, "held_out", "score", "predicted"])

    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(rate, T.StructType([*docs.schema, *added]))


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.drop("text")
