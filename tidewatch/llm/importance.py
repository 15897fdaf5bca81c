"""Importance resampling towards a target distribution, on hashed word features.

The features of a text are its runs of 1 to ``most`` words; each falls into a bucket by its CRC-32. One pass counts
buckets over all texts and over the target, a second sums the gains of each text's buckets, and a Gumbel draw keyed
by the document's id turns weights into a sample without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table
from .crc import crc32_spans
from .word_bytes import words

#: Rows within a partition are numbered in so many bits by Spark's increasing ids.
_ROW_BITS = 33


def _features(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text and bucket of each feature."""
    w = words(texts)
    owners, found = [], []
    for n in range(1, most + 1):
        last = np.arange(n - 1, len(w.at))
        first = last - (n - 1)
        whole = w.text[first] == w.text[last]  # no run goes on from one text to the next
        first, last = first[whole], last[whole]
        found.append(crc32_spans(w.line, w.at[first], w.at[last] + w.size[last] - w.at[first]) % buckets)
        owners.append(w.text[first])
    return np.bincount(w.text, minlength=len(texts)), np.concatenate(owners), np.concatenate(found)


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """How often the features of all texts fall into each bucket: bucket, n. Counts are summed in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(_features(batch.column("text"), most, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """A bucket's gain: floor(1000 ln) of its share in the target over its share in docs, both smoothed by one.

    Both counts come to the driver, `buckets` numbers each, whatever the input.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, of in ((s, docs), (t, target)):
        for row in bucket_counts(of, text, most, buckets).collect():
            into[row.bucket] = row.n
    all_s, all_t = s.sum(), t.sum()
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_: str = "doc_id", text: str = "text", most: int = 1) -> DataFrame:
    """The id, words, features and weight (the gains of its features, summed) of each document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, owner, bucket = _features(batch.column("text"), most, len(gain))
            features = np.bincount(owner, minlength=len(n))
            weight = np.zeros(len(n), np.int64)
            np.add.at(weight, owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: str, id_: Column) -> Column:
    """floor(1000 * a standard Gumbel number), the same for the same id: from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", most: int = 1, buckets: int = 10_000, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank; a rank from 1 marks the drawn ones.

    Of the documents with at least `least_words` words, floor(percent * their number / 100) of the highest scores are drawn, ties to
    the smaller id. A null text has no words and weight 0. A null id has no score: it is never drawn nor counted among
    them, but its words count. Repeated rows are documents of their own. Other columns are ignored; empty tables give no rows.

    Ranks come from a sort over ranges and the row counts of its partitions; no task sees more than its range.
    """
    gain = gains(docs, target, text, most, buckets)
    found = weighed(docs, gain, id_, text, most).withColumn("score", F.col("weight") + gumbel(seed, F.col("id")))
    found = found.withColumn("eligible", (F.col("n_words") >= least_words) & F.col("id").isNotNull())
    order = [F.desc("eligible"), F.desc("score"), F.asc("id")]
    found = stored(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _ROW_BITS)
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row a partition
    draw = percent * (sizes.agg(F.sum("n_eligible")).first()[0] or 0) // 100
    rank = F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    found = found.withColumn("part", part).join(F.broadcast(sizes.select("part", "before")), "part")
    drawn = F.when(F.col("eligible") & (rank <= draw), rank)
    return found.select(F.col("id").alias(id_), "n_words", "n_features", "weight", "score", drawn.alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
