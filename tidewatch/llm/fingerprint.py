"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

Of all 5-word shingle hashes of a text, those below a fixed fraction of the hash range are kept. Sketches of
a union are unions of sketches, and the share of one document within another can be estimated from any
two of them, however unequal in length. The least hash is always kept, so that short texts, too, have
fingerprints that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BREAKS, fold, stored, table

WIDTH = 5
#: One shingle hash in so many is kept.
SCALE = 8
#: Documents in a block of consecutive ids, within which neighbours are found.
BLOCK = 64
#: Quantiles of the ids between which blocks are cut, and the accuracy of their ranks.
QUANTILES, ACCURACY = 1_000, 10_000


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The kept shingle hashes of a text, sorted; empty for a null text or one without words.

    A-Z are lower-cased. A text of fewer than five words has one hash of all of them.
    """
    words = F.filter(F.split(fold(F.coalesce(text, F.lit(""))), WORD_BREAKS), lambda w: w != "")
    limit = F.lit(-(2**63) + 2**64 // scale)

    def hashes(w: Column) -> Column:
        n = F.size(w)
        rolled = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(WIDTH))))
        return F.when(n >= WIDTH, rolled).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < limit)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(low)

    return let(words, lambda w: let(hashes(w), kept))


def as_text(s: Column) -> Column:
    """A fingerprint as text: its hashes in hexadecimal, one after another."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; 1 between two empty fingerprints, 0 between an empty and another."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1; 1 for an empty fingerprint."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of two texts taken together (without the shingles across their seam)."""
    limit = F.lit(-(2**63) + 2**64 // scale)
    whole = F.array_sort(F.array_union(a, b))
    return let(whole, lambda w: let(F.filter(w, lambda x: x < limit), lambda low: F.when(F.size(low) > 0, low).otherwise(F.slice(w, 1, 1))))


def successors(keys: DataFrame) -> DataFrame:
    """(k, next): for distinct numbers k, the next smaller one; after the smallest comes the largest.

    Up to 10,000 numbers are put in order by one window; more are cut into blocks, in each of which a
    window does it, and the ends of the blocks follow from the blocks' own order.
    """
    n, low, high = keys.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
    if n <= 10_000:
        return keys.select("k", F.coalesce(F.lead("k").over(Window.orderBy(F.desc("k"))), F.lit(high)).alias("next"))
    width = max(1, (high - low + 1) * 1_000 // n)
    held = keys.withColumn("b", F.expr(f"k div {width}"))
    inside = held.select("k", "b", F.lead("k").over(Window.partitionBy("b").orderBy(F.desc("k"))).alias("next"))
    tops = held.groupBy("b").agg(F.max("k").alias("next"))
    order = successors(tops.select(F.col("b").alias("k"))).toDF("b", "after")
    ends = inside.where("next is null").select("k", "b").join(order, "b").join(tops.withColumnRenamed("b", "after"), "after").select("k", "next")
    return inside.where("next is not null").select("k", "next").union(ends)


def _blocks(docs: DataFrame, columns: tuple[str, ...], block: int) -> Column:
    """The number of each row's block of about `block` rows, rising with doc_id; null ids have negative ones, by a hash of the columns.

    Blocks are cut between quantiles of the ids, and evenly between two of them: an id far from all others
    shifts no more than the rows beside it. The quantiles are found by bisection.
    """
    every = [k / QUANTILES for k in range(QUANTILES + 1)]
    n, nulls, found = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx(F.col("doc_id").cast("long"), every, ACCURACY)).first()
    shares = min(QUANTILES, max(1, n // block))
    bounds = sorted({found[k * QUANTILES // shares] for k in range(shares + 1)}) if n else [0]
    held, cuts, doc_id = F.lit(bounds).cast("array<bigint>"), -(-n // shares // block) or 1, F.col("doc_id").cast("long")
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    share = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step) <= doc_id, at + step).otherwise(at))

    def cut(at: Column) -> Column:
        low, high = F.get(held, at).cast("double"), F.get(held, at + 1).cast("double")
        inside = F.floor((doc_id.cast("double") - low) / (high - low) * cuts)
        return at.cast("long") * cuts + F.greatest(F.lit(0), F.least(F.lit(cuts - 1), F.coalesce(inside, F.lit(0))))

    unnamed = -1 - F.pmod(F.xxhash64(*columns), F.lit(max(1, nulls // block)))
    # Never null, and known to be so: else the joins on it filter below the shuffle of texts, which is then done twice.
    return F.coalesce(F.when(doc_id.isNotNull(), let(share, cut)), unnamed, F.lit(-1))


def with_next(docs: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """docs with next_<column> of the next row by descending doc_id (after the last row: of the first).

    Rows of one id are ordered by the columns; null ids come last, many of them in the order of a hash of the
    columns; a single row is followed by itself. Ids are cut into blocks of about `block` rows; the rows of
    one id are in one block. A window within each block finds the next row, so texts are shuffled once; only
    the last row of each block is joined with the first of the next.
    """
    number = _blocks(docs, columns, block)
    held = docs.withColumn("__block", number)
    within = Window.partitionBy("__block").orderBy(F.col("doc_id").desc_nulls_last(), *columns)
    held = held.withColumns({f"next_{c}": F.lead(c).over(within) for c in columns} | {"__more": F.lead(F.lit(True)).over(within), "__nth": F.row_number().over(within)})
    names = [*docs.columns, *(f"next_{c}" for c in columns)]
    blocks = stored(docs.select(number.alias("k")).distinct())
    order = successors(blocks).toDF("__block", "__after")
    heads = held.where("__nth = 1").select(F.col("__block").alias("__after"), *(F.col(c).alias(f"next_{c}") for c in columns))
    ends = held.where("__more is null").drop(*(f"next_{c}" for c in columns)).join(order, "__block").join(heads, "__after")
    return held.where("__more is not null").select(*names).union(ends.select(*names))


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half begins like the next document.

    The last floor(n_chars / 2) code points are replaced by as many of the next document by descending
    doc_id, or by all of it. A null text counts as empty. One row for each row of docs; an empty table
    gives none.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = held.withColumn("sketch", sketch(F.col("text")))
    held = with_next(held, "text", "sketch").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    held = held.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    held = held.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return held.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
    )


def op3_fingerprint(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
