"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. A source with u of D shares may start its block j no earlier
than floor(j * D / u) and must have had it by ceil((j + 1) * D / u); of the blocks that may start, the one
with the earliest deadline goes next. At every point of the mix each source is then less than one block
away from its target. The pattern repeats every D slots. Sources of equal shares have the same release times
and deadlines, so one period is laid out by classes of equal shares, however many sources there are, and
every block finds its slot by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Documents a block; rows to a salt of a source, and sources to a salt of a class.
BLOCK, SALT_ROWS = 32, 4096
#: What the different shares may add up to: a bound on the parameters, whatever the data (the layout is broadcast).
MOST_SHARES = 200_000
#: Shares of the sources in the query, and of each source that is not named.
SHARES = {"src0": 40, "src1": 20, "src2": 20}
OTHERS = 10


def layout(classes: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(units, block, first, last, slot): members first to last of the sources with so many units have that block from the slot on.

    classes gives the number of sources with each number of units. The earliest deadline goes first, of equal
    ones that of fewer units. There are at most twice as many rows as the different units add up to.
    """
    if sum(classes) > MOST_SHARES:
        raise ValueError(f"different shares add up to {sum(classes)}, more than {MOST_SHARES}: give the sources coarser shares")
    total = sum(u * n for u, n in classes.items())
    waiting = [(0, u, 0) for u in classes]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out: list[tuple[int, int, int, int, int]] = []
    slot = 0
    while slot < total:
        while waiting and waiting[0][0] <= slot:
            _, u, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // u), u, block, 0))
            if block + 1 < u:
                heapq.heappush(waiting, ((block + 1) * total // u, u, block + 1))
        deadline, u, block, member = heapq.heappop(ready)
        run = min([classes[u] - member] + [w[0] - slot for w in waiting[:1]])
        if out and out[-1][:2] == (u, block):
            out[-1] = (*out[-1][:3], member + run - 1, out[-1][4])
        else:
            out.append((u, block, member, member + run - 1, slot))
        slot += run
        if member + run < classes[u]:
            heapq.heappush(ready, (deadline, u, block, member + run))
    return out


def _salt(key: str, salts: int) -> Column:
    """One of so many salts, rising with a hexadecimal key."""
    return F.expr(f"cast(conv(substring({key}, 1, 8), 16, 10) as bigint) * {salts} div 4294967296")


def _ranked(rows: DataFrame, group: str, order: list[str], shifts: DataFrame) -> DataFrame:
    """rows with __rank: their numbers from 0 within the group, counted within each salt and shifted by the salts before it."""
    within = Window.partitionBy(group, "__salt").orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(within) - 1).join(shifts, [group, "__salt"]).withColumn("__rank", F.col("__nth") + F.col("__shift")).drop("__nth", "__shift")


def _shifts(sizes: DataFrame, group: str) -> DataFrame:
    """sizes (group, __salt, n) with __shift: the rows of the group in earlier salts."""
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def _order(source: Column) -> Column:
    return F.md5(F.concat_ws("/", F.coalesce(source, F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _members(names: DataFrame, shares: dict[str, int], others: int) -> DataFrame:
    """(__name, __u, __member): each source's units, and its number among the sources with as many."""
    given = names.sparkSession.createDataFrame(list(shares.items()), "__name string, __given long")
    salts = max(1, names.count() // SALT_ROWS)
    named = names.join(F.broadcast(given), "__name", "left").select("__name", F.coalesce("__given", F.lit(others)).cast("long").alias("__u"))
    named = named.withColumn("__key", F.md5(F.col("__name").cast("binary"))).withColumn("__salt", _salt("__key", salts))
    sizes = named.groupBy("__u", "__salt").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(named, "__u", ["__key", "__name"], _shifts(sizes, "__u")).select("__name", "__u", F.col("__rank").alias("__member"))


def mix(docs: DataFrame, shares: dict[str, int], others: int, block: int = BLOCK) -> DataFrame:
    """docs with block, slot and place added: the mix is the rows by (slot, place). Every row stays.

    Within a source, documents come in the order of a hash of source and id, ties by id. Sources that are
    not named, the null source among them, have `others` shares each, any number of them. Once a source is
    exhausted its slots stay empty and the rest go on at their own pace. Large sources are salted: ranks are
    counted within each salt and shifted by the sizes of the salts before it. Columns of the three names are
    replaced; an empty table gives an empty result.
    """
    docs = docs.drop("block", "slot", "place")
    spark = docs.sparkSession
    named = docs.withColumn("__name", F.coalesce("source", F.lit(""))).withColumn("__key", _order(F.col("source")))
    named = named.withColumn("__salt", _salt("__key", max(1, docs.count() // SALT_ROWS)))
    sizes = stored(named.groupBy("__name", "__salt").agg(F.count(F.lit(1)).alias("n")))
    members = stored(_members(sizes.select("__name").distinct(), shares, others))
    classes = {r["__u"]: r["n"] for r in members.groupBy("__u").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each different share
    if any(u <= 0 for u in classes):
        raise ValueError("every source needs a share")
    laid = spark.createDataFrame(layout(classes), "__of long, __in long, __first long, __last long, __at long")
    total = sum(u * n for u, n in classes.items())

    # What is known of a source travels with its salts, so that no join meets on the source alone.
    shifts = _shifts(sizes, "__name").join(members, "__name")
    ranked = _ranked(named, "__name", ["__key", "doc_id"], shifts)
    ranked = ranked.withColumns({"block": F.expr(f"__rank div {block}"), "place": F.expr(f"__rank % {block}").cast("int")})
    found = (F.col("__u") == F.col("__of")) & (F.expr("block % __u") == F.col("__in")) & F.col("__member").between(F.col("__first"), F.col("__last"))
    mixed = ranked.join(F.broadcast(laid), found)
    mixed = mixed.withColumn("slot", F.expr(f"(block div __u) * {total} + __at + __member - __first"))
    return mixed.select(*docs.columns, "block", "slot", "place")


def in_order(mixed: DataFrame, parts: int) -> DataFrame:
    """The rows of a mix, range-partitioned and sorted: files written from it hold the mix in order."""
    return mixed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place")


def op7_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, SHARES, OTHERS)
