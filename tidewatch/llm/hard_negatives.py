"""Hard negatives by inner product, found with LEMP-style coordinate pruning.

Anchors, a stated set of the rows, meet all rows in cells: a cell holds a bounded share of the anchors and a
bounded share of the rows, both dealt by a hash of their ids, so that no label, length or copied vector decides
a cell's size. Inside a cell the rows stand in buckets of falling length. A bucket keeps, for each coordinate,
the sorted list of its unit vectors' values. A score that an anchor asks for bounds the angle to any row of the
bucket (or skips the bucket, if even its longest row is too short), and so bounds each coordinate of that row.
The ranges of the anchor's largest coordinates are cut out of the sorted lists and intersected, and only what
is left is verified by the exact integer product. The score that is asked for rises as results are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored, table

#: Components (rows times dimensions) of the anchors, and of the rows, in one cell.
CELL = 1 << 19
#: Rows of a bucket at most, and the least length in it as a share of its greatest.
BUCKET, SPREAD = 1024, 0.9
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
#: Widening of ranges, far above the rounding of unit vectors.
SLACK = 1e-9
#: Floating-point products are exact below this; longer vectors are multiplied as Python integers.
EXACT = float(1 << 53)


class _Rows:
    """The ids, labels and integer vectors of one side of a cell."""

    def __init__(self, t: pa.Table, vector: str, scale: float):
        self.ids = t.column("id").to_numpy()
        self.labels = np.array(t.column("label").to_pylist(), object)
        lists = t.column(vector).combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        self.vectors = np.zeros((len(sizes), int(sizes.max(initial=0))))
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
        self.vectors[np.arange(self.vectors.shape[1]) < sizes[:, None]] = np.floor(scale * flat)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))

    def widen(self, dims: int) -> None:
        self.vectors = np.pad(self.vectors, ((0, 0), (0, dims - self.vectors.shape[1])))

    def unit(self, at) -> np.ndarray:
        return self.vectors[at] / np.maximum(self.lengths[at], 1e-300)[..., None]


class _Bucket:
    """Rows of like length with one sorted list for each coordinate."""

    def __init__(self, rows: _Rows, at: np.ndarray, exact: bool):
        self.ids, self.labels, self.longest = rows.ids[at], rows.labels[at], rows.lengths[at[0]]
        self.vectors = rows.vectors[at]
        units = rows.unit(at)
        self.order = np.argsort(units, axis=0).T
        self.values = np.take_along_axis(units, self.order.T, axis=0).T.copy()
        if not exact:
            self.vectors = np.frompyfunc(int, 1, 1)(self.vectors)

    def candidates(self, length: float, unit: np.ndarray, focus: np.ndarray, least: float) -> np.ndarray | slice | None:
        """Rows whose product with the anchor can be `least`: their places, all of them, or None."""
        if least <= 0:
            return slice(None)
        cosine = least / max(length * self.longest, 1e-300)
        if cosine > 1 + SLACK:
            return None
        reach = math.acos(min(1.0, cosine))
        ranges = []
        for f in focus:
            angle = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, angle + reach)) - SLACK, math.cos(max(0.0, angle - reach)) + SLACK
            a, b = self.values[f].searchsorted((low, high))
            ranges.append((b - a, a, b, f))
        if 2 * min(ranges)[0] > len(self.ids):
            return slice(None)  # verifying all costs less than cutting
        marks = np.zeros(len(self.ids), np.uint8)
        for _, a, b, f in ranges:
            marks[self.order[f][a:b]] += 1
        return np.flatnonzero(marks == len(ranges))

    def scored(self, anchor: np.ndarray, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[found], self.labels[found], (self.vectors[found] @ anchor).astype(np.int64)


def _buckets(rows: _Rows, at: np.ndarray, exact: bool) -> list[_Bucket]:
    """Buckets of the rows at these places, by falling length."""
    at = at[np.argsort(-rows.lengths[at], kind="stable")]
    out, start = [], 0
    while start < len(at):
        end = min(len(at), start + BUCKET)
        lengths = rows.lengths[at[start:end]]
        end = start + max(1, int(np.searchsorted(-lengths, -SPREAD * lengths[0], "right")))
        out.append(_Bucket(rows, at[start:end], exact))
        start = end
    return out


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def _sides(left: pa.Table, right: pa.Table, vector: str, scale: float):
    """Anchors and rows of a cell, of equal dimensions, and their vectors as numbers that multiply exactly."""
    anchors, rows = _Rows(left, vector, scale), _Rows(right, vector, scale)
    dims = max(anchors.vectors.shape[1], rows.vectors.shape[1], 1)
    anchors.widen(dims)
    rows.widen(dims)
    exact = anchors.lengths.max() * rows.lengths.max() < EXACT
    queries = anchors.vectors if exact else np.frompyfunc(int, 1, 1)(anchors.vectors)
    units = anchors.unit(slice(None))
    focus = np.argsort(-np.abs(units), axis=1)[:, :FOCUS]
    return anchors, rows, exact, queries, units, focus


def _positives_of(left: pa.Table, right: pa.Table, vector: str, scale: float, k: int) -> Iterator[tuple]:
    """The first k other rows of each anchor's label in a cell: (anchor, row, score)."""
    anchors, rows, exact, queries, units, focus = _sides(left, right, vector, scale)
    of = {}
    for place, label in enumerate(rows.labels):
        of.setdefault(label, []).append(place)
    wanted = {}
    for i, label in enumerate(anchors.labels):
        wanted.setdefault(label, []).append(i)
    for label, here in wanted.items():
        buckets = _buckets(rows, np.array(of.get(label, []), np.int64), exact)
        for i in here:
            ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), -math.inf
            for bucket in buckets:
                found = bucket.candidates(anchors.lengths[i], units[i], focus[i], least)
                if found is None:
                    break  # later buckets are shorter
                new, _, s = bucket.scored(queries[i], found)
                keep = (new != anchors.ids[i]) & (s >= least)
                ids, scores = _first(np.concatenate([ids, new[keep]]), np.concatenate([scores, s[keep]]), k)
                least = scores[-1] if len(scores) == k else least
            yield from ((anchors.ids[i], b, s) for b, s in zip(ids, scores, strict=True))


def _negatives_of(left: pa.Table, right: pa.Table, vector: str, scale: float, k: int, low: int, high: int) -> Iterator[tuple]:
    """The first k rows of another label within the band of each positive in a cell: (anchor, positive, row, scores)."""
    anchors, rows, exact, queries, units, focus = _sides(left, right, vector, scale)
    buckets = _buckets(rows, np.arange(len(rows.ids)), exact)
    for i, positives in enumerate(left.column("positives").to_pylist()):
        bands = {s: (-(-low * s // 100), high * s // 100) for s in {p["score"] for p in positives}}
        best = {s: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for s, (a, b) in bands.items() if a <= b}
        least = {s: bands[s][0] for s in best}
        for bucket in buckets if best else ():
            lowest = min(least.values())
            found = bucket.candidates(anchors.lengths[i], units[i], focus[i], lowest)
            if found is None:
                break
            ids, labels, scores = bucket.scored(queries[i], found)
            keep = (scores >= lowest) & (labels != anchors.labels[i])
            if not keep.any():
                continue
            ids, scores = _first(ids[keep], scores[keep], keep.sum())
            for s in best:
                start = np.searchsorted(-scores, -bands[s][1])
                end = np.searchsorted(-scores, -least[s], "right")
                if start < end:
                    take = slice(start, min(end, start + k))
                    best[s] = _first(np.concatenate([best[s][0], ids[take]]), np.concatenate([best[s][1], scores[take]]), k)
                    least[s] = best[s][1][-1] if len(best[s][0]) == k else least[s]
        for p in positives:
            for b, s in zip(*best.get(p["score"], ((), ())), strict=True):
                yield anchors.ids[i], p["id"], b, p["score"], s


def _per_cell(of, schema: pa.Schema, *args):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(of(left, right, *args)) if left.num_rows and right.num_rows else []
        release()
        return pa.table([pa.array([int(r[j]) for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return cell


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256, id_: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of another label
    whose score lies between low and high percent of the positive's; columns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    A score is the inner product of floor(scale * x) over the components, as integers; higher ones come first, equal ones by id.
    Left out are rows with a null id, label or vector and those with a null or non-finite component. Of rows that repeat an id,
    the least (label, vector) counts. Shorter vectors, empty ones too, are filled up with zeros. A positive of negative
    score has no band. A score beyond 64 bits is an error. Other columns are ignored. An empty table gives no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.select(F.col(id_).cast("long").alias("id"), label.alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    kept = kept.dropna(subset=["id", "label", "vector"]).where(F.forall("vector", _finite))
    kept = stored(kept.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*"))
    count, dims, queries = kept.agg(F.count("id"), F.max(F.size("vector")), F.count_if("anchor")).first()
    shards, groups = (max(1, -(-n * (dims or 1) // CELL)) for n in (count, queries))
    first_cell, group = F.pmod(F.xxhash64("id"), F.lit(shards)) * groups, F.pmod(F.xxhash64(F.lit("anchor"), "id"), F.lit(groups))
    dealt = kept.select("id", "label", "vector", F.explode(F.sequence(first_cell, first_cell + (groups - 1))).alias("cell")).groupBy("cell")
    anchors = kept.where("anchor").drop("anchor")

    def met(left: DataFrame, of, out: pa.Schema, *args) -> DataFrame:
        spread = left.withColumn("cell", F.explode(F.sequence(group, group + (shards - 1) * groups, F.lit(groups).cast("long"))))
        spread = spread.toDF(*spread.columns)  # new columns, as both sides come from the same rows
        return spread.groupBy("cell").cogroup(dealt).applyInArrow(_per_cell(of, out, "vector", scale, *args), ", ".join(f"{n} long" for n in out.names))

    first = met(anchors, _positives_of, _longs("anchor_id", "id", "score"), positives)
    first = _ranked(first, ["anchor_id"], "score", "id", positives)
    held = first.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # a bounded list
    held = anchors.join(held.withColumnRenamed("anchor_id", "id"), "id")
    found = met(held, _negatives_of, _longs("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), negatives, low, high)
    found = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _ranked(df: DataFrame, by: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k of each task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all others, within 80 to 100 percent of each positive's score."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


OP11_SQL = """
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
        CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM kept a JOIN kept r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
    s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""
