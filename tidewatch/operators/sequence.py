"""Tactics, activity clusters, segments, lateral movement and propagation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.details import TACTICS, level_rank, phase
from ..functions.timestamps import as_text, strict
from ..plans import ranges
from ..sources.logs import SEPARATOR, resolve_detail_source
from ..sources.shared import stored
from .filters import lateral_default
from .profile import active_days

GUARD = 10_000_000
#: Rows of either side that one cell of a join holds, about.
SIDE = 2_000
#: Pairs of rows that one task of a join looks at, about.
TASK = 4 * SIDE * SIDE
#: The same as SIDE where pairs are counted and not made.
COUNTED_SIDE = 100_000


def tactic_rows(df: DataFrame, tactics: list[str] | None = None) -> DataFrame:
    """Rows by tactic code, matched as a substring; the codes are the fixed table of fourteen, or those given."""
    codes = df.sparkSession.createDataFrame([(c,) for c in (TACTICS if tactics is None else tactics)], "tactic string")
    return df.join(F.broadcast(codes), F.instr("MitreTactics", F.col("tactic")) > 0)


def first_per_tactic(df: DataFrame, tactics: list[str] | None = None, detail_source: str = "Details") -> DataFrame:
    """The first row of each tactic by time (unparsed last), then by time text, host, rule and details.

    Codes given that the table does not know stand for themselves; a code given twice counts once. The details come from the column
    that `detail_source` names, in any case. Rows that tie in all of these look alike.
    """
    details = resolve_detail_source(df, detail_source)
    tactics = None if tactics is None else list(dict.fromkeys(tactics))
    keys = ["Timestamp", "Computer", "RuleTitle", details]
    order = Window.partitionBy("tactic").orderBy(strict(F.col("Timestamp")).asc_nulls_last(), *[F.asc_nulls_last(k) for k in keys])
    rows = tactic_rows(df, tactics).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return rows.select(phase(F.col("tactic")).alias("Phase"), F.col("Timestamp").alias("FirstSeen"), "Computer", F.col("RuleTitle").alias("Event"), F.col(details).alias("Details"))


def tactic_flow(df: DataFrame) -> DataFrame:
    """Per tactic: rows, hosts, first and last sighting, the tactic that follows it in time, and the techniques first met in it.

    Tactics stand in the order of their first sighting (then by code). A technique, a part of MitreTags, belongs to the
    first of the tactics on whose rows it occurs.
    """
    rows = tactic_rows(df)
    out = rows.groupBy("tactic").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("Computer").alias("hosts"), F.min("Timestamp").alias("first_seen"), F.max("Timestamp").alias("last_seen"))
    tags = F.col("MitreTags") if "MitreTags" in df.columns else F.lit(None).cast("string")
    used = rows.select("tactic", F.explode(F.split(tags, SEPARATOR)).alias("technique")).where("trim(technique) <> ''").distinct()
    # A table of fourteen tactics, and one row for each technique of theirs.
    first = used.join(F.broadcast(out.select("tactic", "first_seen")), "tactic").groupBy("technique").agg(F.min_by("tactic", F.struct("first_seen", "tactic")).alias("tactic"))
    held = first.groupBy("tactic").agg(F.array_join(F.array_sort(F.collect_set("technique")), ", ").alias("techniques"))
    out = out.withColumn("next_tactic", F.lead("tactic").over(Window.orderBy("first_seen", "tactic")))
    return out.join(F.broadcast(held), "tactic", "left").withColumn("techniques", F.coalesce("techniques", F.lit("")))


def flow_edges(df: DataFrame) -> DataFrame:
    """(source, target, kind) of the flow's drawing: from each tactic to the next, and to each of its own techniques."""
    flow = tactic_flow(df)
    steps = flow.where("next_tactic IS NOT NULL").select(F.col("tactic").alias("source"), F.col("next_tactic").alias("target"), F.lit("flow").alias("kind"))
    own = flow.where("techniques <> ''").select("tactic", F.explode(F.split("techniques", ", ")), F.lit("technique"))
    return steps.union(own)


def clusters(df: DataFrame, levels: tuple[str, ...] = ("high", "crit"), gap: int = 7) -> DataFrame:
    """Stretches of active days with no gap above so many days; over all levels where those given have no day."""
    days = active_days(df, levels)
    if days.isEmpty():
        days = active_days(df, ())
    order = Window.orderBy("day")  # one row a day: bounded by the calendar
    marked = days.withColumn("new", F.coalesce(F.datediff("day", F.lag("day").over(order)) > gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("n", F.sum("new").over(order))
    return numbered.groupBy("n").agg(F.min("day").alias("start"), F.max("day").alias("end")).select(F.concat(F.lit("c"), "n").alias("id"), "start", "end")


def segments(df: DataFrame) -> DataFrame:
    """Segments of the whole timeline with padded start and end: (segment, start, end, points).

    All rows form one ordered list, whatever their host. With three gaps or more, a gap over five times their median is a
    break; with fewer, the first of the largest ones, if it is over 30 % of the span. Segments are padded by 5 % of
    their length (a single row counts as an hour), an unbroken timeline by 2 %, a minute at least; a timeline of
    a single row by an hour. Rows without a parsed time do not count.

    Rows of one time are counted first; the times are then sorted by ranges, and gaps, their median and the numbers
    of segments pass from range to range, so that no task sees the whole list.
    """
    times = df.select(F.unix_micros(strict(F.col("Timestamp"))).alias("us")).where("us is not null").groupBy("us").agg(F.count(F.lit(1)).alias("n"))
    gaps = ranges.previous(ranges.in_ranges(times, F.col("us")), "us", "before").withColumn("gap", F.col("us") - F.col("before"))
    # A time with n rows stands for n - 1 gaps of nothing.
    none = gaps.agg(F.lit(0).cast("long").alias("gap"), F.sum(F.col("n") - 1).alias("n")).where("n > 0")
    counted = gaps.where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n")).unionByName(none)
    first_largest = F.max(F.struct("gap", (-F.col("us")).alias("at")))
    rows, span, top = gaps.agg(F.sum("n"), F.max("us") - F.min("us"), first_largest).first()
    if (rows or 0) > 3:
        broken = F.col("gap") > 5 * ranges.median(counted, "gap", "n")
    else:
        broken = (F.col("us") == -top.at) & (F.col("gap") / span > 0.3) if top and span else F.lit(False)
    marked = ranges.running(gaps, breaks=broken.cast("long"))
    out = marked.groupBy((F.col("breaks") + 1).alias("segment")).agg(F.min("us").alias("a"), F.max("us").alias("b"), F.sum("n").alias("points"))
    minute, hour = 60_000_000, 3_600_000_000
    length = F.when(F.col("points") > 1, F.col("b") - F.col("a")).otherwise(F.lit(hour))
    part = lambda us, n: F.greatest(F.bround(us / F.lit(float(n))), F.lit(float(minute)))
    pad = F.when(F.col("points") < rows, part(length, 20)).otherwise(F.lit(float(hour)) if rows == 1 else part(F.col("b") - F.col("a"), 50)).cast("long")
    text = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSS")
    return out.select("segment", text(F.col("a") - pad).alias("start"), text(F.col("b") + pad).alias("end"), "points")


def rule_samples(df: DataFrame, rows: int = 2) -> DataFrame:
    order = Window.partitionBy("RuleTitle").orderBy("Timestamp", "Computer", "RecordID", "Channel", F.asc_nulls_last("Details"))
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("RuleTitle", "nth", "Timestamp", "Computer", "RecordID")


def event_representatives(df: DataFrame) -> DataFrame:
    """One row per event: of several rules the most severe, then the smallest title."""
    order = Window.partitionBy("RecordID", "Computer", "Channel").orderBy(F.desc(level_rank(F.col("Level"))), "RuleTitle", "Timestamp", F.asc_nulls_last("Details"))
    return df.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("RecordID", "Computer", "Channel", "RuleTitle", "Level", "Timestamp")


def timeline_representatives(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first high or critical row of each host and rule, the earliest so many of them."""
    first = df.where(F.col("Level").isin("high", "crit")).groupBy("Computer", "RuleTitle").agg(F.min(F.struct("Timestamp", "Level", "RecordID")).alias("r"))
    return first.select("Computer", "RuleTitle", "r.Timestamp", "r.Level", "r.RecordID").orderBy("Timestamp", "Computer", "RuleTitle").limit(rows)


def _moves(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    rows = df.where(F.col("Level").isin(*levels)) if levels else lateral_default(df)
    return rows.withColumn("us", F.unix_micros(strict(F.col("Timestamp")))).where("us is not null")


def in_cells(a: DataFrame, b: DataFrame, key: str, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on a key, cut finer where a key has many rows: they meet on the key and a column `cell`.

    Where a key has more than `side` rows on either side, the rows of each side are dealt by a hash of all their columns into parts of
    about `side` rows, and each part of one side meets each part of the other in a cell of its own. Parts follow from
    counts of each key, and a row goes to as many cells as the other side has parts there: one, for most keys.
    """
    count = lambda df, n, m: df.groupBy(key).agg(F.count(F.lit(n)).alias("n_a"), F.count(F.lit(m)).alias("n_b"))
    sizes = count(a, 1, None).union(count(b, None, 1)).groupBy(key).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    full = sizes.where(((F.col("n_a") > side) | (F.col("n_b") > side)) & (F.col("n_a") > 0) & (F.col("n_b") > 0))
    parts = full.select(key, F.ceil(F.col("n_a") / side).alias("_pa"), F.ceil(F.col("n_b") / side).alias("_pb"))

    def dealt(df: DataFrame, own: str, cells) -> DataFrame:
        row = F.xxhash64(*df.columns)
        out = df.join(parts, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_pa", "_pb")})
        out = out.withColumn("_part", F.pmod(row, F.col(own)))
        return out.withColumn("cell", F.explode(cells)).drop("_pa", "_pb", "_part")

    begin = F.col("_part") * F.col("_pb")
    across = F.transform(F.sequence(F.lit(0), F.col("_pa") - 1), lambda i: i * F.col("_pb") + F.col("_part"))
    return dealt(a, "_pa", F.sequence(begin, begin + F.col("_pb") - 1)), dealt(b, "_pb", across)


def lateral_pairs(df: DataFrame, minutes: int = 60, levels: tuple[str, ...] = (), source: str = "", target: str = "") -> DataFrame:
    """Pairs of rows on different hosts, the second within the window after the first.

    Times are cut into buckets as wide as the window. A row meets the rows of its own bucket and of the
    next, so the interval join is an equi-join. A bucket with a burst of rows is cut into cells that hold about SIDE
    rows of each side, so its pairs are shared out among tasks, each of which looks at about TASK pairs. Rows are derived once and
    stored.
    """
    if not 1 <= minutes <= 1440:
        raise ValueError("the window is 1 to 1440 minutes")
    width = minutes * 60_000_000
    rows = _moves(df, levels).withColumn("bucket", F.floor(F.col("us") / width))
    number = F.xxhash64(*df.columns).alias("row")  # tells rows apart that look alike below
    shown = as_text(F.timestamp_micros("us")).alias("Time")  # once a row, not once a pair
    rows = stored(rows.select("us", "bucket", number, shown, "Computer", "RuleTitle", "Level"))
    side = lambda at, end: [F.col("us").alias(at), "row", F.col("Time").alias(f"{end}Time"), *(F.col(c).alias(f"{end}{n}") for c, n in (("Computer", "Host"), ("RuleTitle", "Event"), ("Level", "Level")))]
    a = rows.where(F.col("Computer").contains(source)).select("bucket", *side("sus", "Source"))
    b = rows.where(F.col("Computer").contains(target)).select(F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), *side("tus", "Target"))
    met = a.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket")
    tasks = math.ceil((met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) / TASK)
    a, b = in_cells(a, b, "bucket")
    if tasks > 1:  # Spark deals tasks by the bytes that they read, which say nothing of the pairs
        a, b = (x.repartition(tasks, "bucket", "cell") for x in (a, b))
    pairs = a.drop("row").join(b.drop("row"), ["bucket", "cell"]).where(f"tus BETWEEN sus AND sus + {width} AND SourceHost <> TargetHost")
    delta = (F.expr("(tus - sus + 3000000) div 6000000") / F.lit(10.0)).alias("DeltaMinutes")  # rounded half up, in whole numbers
    return pairs.select(*(f"{end}{n}" for end in ("Source", "Target") for n in ("Time", "Host", "Event", "Level")), delta)


def _by_end(rows: pd.DataFrame, side: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by their end (host and level) and time, and where each end begins."""
    end = rows.groupby([f"{side}_host", f"{side}_level"], dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((rows[f"{side}_us"].to_numpy(), end))
    return rows.iloc[order], np.flatnonzero(np.diff(end[order], prepend=-1))


def _counted_pairs(a: pd.DataFrame, b: pd.DataFrame, width: int) -> pd.DataFrame:
    """Pairs of one cell by their ends: the source rows are looked up in the sorted times of each target end."""
    columns = ["SourceHost", "SourceLevel", "TargetHost", "TargetLevel", "count"]
    if a.empty or b.empty:
        return pd.DataFrame([], columns=columns)
    (a, first), (b, begins) = _by_end(a, "s"), _by_end(b, "t")
    at, n = a["s_us"].to_numpy(), a["s_n"].to_numpy()
    hosts, levels = (a[c].to_numpy(dtype=object)[first] for c in ("s_host", "s_level"))
    us, m, others, theirs = (b[c].to_numpy() for c in ("t_us", "t_n", "t_host", "t_level"))
    out = []
    for i, j in zip(begins, [*begins[1:], len(b)]):
        upto = np.concatenate([[0], m[i:j].cumsum()])
        within = upto[np.searchsorted(us[i:j], at + width, "right")] - upto[np.searchsorted(us[i:j], at, "left")]
        counts = np.add.reduceat(n * within, first)
        out += [(hosts[k], levels[k], others[i], theirs[i], int(counts[k])) for k in np.flatnonzero((counts > 0) & (hosts != others[i]))]
    return pd.DataFrame(out, columns=columns)


def lateral_counts(df: DataFrame, minutes: int = 60, levels: tuple[str, ...] = (), source: str = "", target: str = "") -> DataFrame:
    """How many of lateral_pairs there are of each SourceHost, SourceLevel, TargetHost and TargetLevel, without making them.

    Rows of one time, host and level are counted first. In each bucket the rows of a source end are looked up in the sorted times of
    each target end, so the work grows with the rows and the ends that meet there. Only a bucket of many rows is cut into cells.
    """
    if not 1 <= minutes <= 1440:
        raise ValueError("the window is 1 to 1440 minutes")
    width = minutes * 60_000_000
    rows = _moves(df, levels).where("Computer is not null").groupBy("us", F.col("Computer").alias("host"), F.col("Level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("bucket", F.floor(F.col("us") / width))
    names = ("us", "host", "level", "n")
    a = rows.where(F.col("host").contains(source)).select("bucket", *(F.col(c).alias(f"s_{c}") for c in names))
    b = rows.where(F.col("host").contains(target)).select(F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), *(F.col(c).alias(f"t_{c}") for c in names))
    a, b = (x.groupBy("bucket", "cell") for x in in_cells(a, b, "bucket", COUNTED_SIDE))
    ddl = "SourceHost string, SourceLevel string, TargetHost string, TargetLevel string, count long"
    met = a.cogroup(b).applyInPandas(lambda x, y: _counted_pairs(x, y, width), ddl)
    return met.groupBy("SourceHost", "SourceLevel", "TargetHost", "TargetLevel").agg(F.sum("count").alias("count"))


def lateral_bound(df: DataFrame, minutes: int = 60, levels: tuple[str, ...] = (), source: str = "", target: str = "") -> DataFrame:
    """An upper bound of the number of pairs, and the rows of each side, from counts in quarter-window buckets, without the join."""
    width = minutes * 15_000_000
    rows = _moves(df, levels).select(F.floor(F.col("us") / width).alias("b"), F.coalesce("Computer", F.lit("")).alias("host"))
    a, b = (rows.where(F.col("host").contains(part)).groupBy("b", "host").agg(F.count(F.lit(1)).alias("n")) for part in (source, target))

    def products(keys: list[str]) -> DataFrame:
        one = a.groupBy(*keys).agg(F.sum("n").alias("n"))
        later = b.groupBy(*keys).agg(F.sum("n").alias("m")).withColumn("b", F.explode(F.sequence(F.col("b") - 4, F.col("b"))))
        return one.join(later, keys).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("p"))

    sides = a.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("source_rows")).crossJoin(b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("target_rows")))  # one row by one row
    whole = products(["b"]).withColumnRenamed("p", "all").crossJoin(products(["b", "host"])).select((F.col("all") - F.col("p")).alias("bound"))
    return whole.crossJoin(sides)


def correlate_lateral(df: DataFrame, minutes: int = 60, levels: tuple[str, ...] = (), most: int | None = GUARD, source: str = "", target: str = "") -> DataFrame:
    """The pairs, or one row with status too_broad, the bound and the rows of each side where the bound is above the limit.

    Only rows of hosts that hold `source` and `target` are counted and joined. With no limit (None) the pairs are served, however many.
    """
    if most is None:
        return lateral_pairs(df, minutes, levels, source, target).withColumn("status", F.lit("ok"))
    found = lateral_bound(df, minutes, levels, source, target).first()  # three numbers
    if found.bound <= most:
        return lateral_pairs(df, minutes, levels, source, target).withColumn("status", F.lit("ok"))
    told = ("too_broad", found.bound, most, found.source_rows, found.target_rows)
    return df.sparkSession.createDataFrame([told], "status string, bound long, most int, source_rows long, target_rows long")


def edge_stats(moves: DataFrame) -> DataFrame:
    """Per source and target: moves (each row's `count`, or one), whether the reverse exists, highest level, drawing width."""
    n = F.col("count") if "count" in moves.columns else F.lit(1)
    rank = F.greatest(level_rank(F.col("SourceLevel")), level_rank(F.col("TargetLevel")))
    edges = moves.groupBy("SourceHost", "TargetHost").agg(F.sum(n).alias("count"), F.max(rank).alias("rank"))
    back = edges.select(F.col("SourceHost").alias("TargetHost"), F.col("TargetHost").alias("SourceHost"), F.lit(True).alias("r"))
    return edges.join(back, ["SourceHost", "TargetHost"], "left").select("SourceHost", "TargetHost", "count", F.coalesce("r", F.lit(False)).alias("reverse"), "rank", F.least(F.col("count") + 1, F.lit(8)).alias("width"))


def node_stats(moves: DataFrame) -> DataFrame:
    """Per host: moves (each row's `count`, or one) from it and to it, both together, the levels seen and the rank of the highest one."""
    n = F.col("count") if "count" in moves.columns else F.lit(1)
    ends = moves.select(F.col("SourceHost").alias("host"), n.alias("s"), F.lit(0).alias("t"), F.col("SourceLevel").alias("level"))
    ends = ends.union(moves.select("TargetHost", F.lit(0), n, "TargetLevel"))
    levels = F.array_join(F.array_sort(F.collect_set("level")), ", ")  # as many as there are levels
    return ends.groupBy("host").agg(F.sum("s").alias("as_source"), F.sum("t").alias("as_target"), F.sum(F.col("s") + F.col("t")).alias("event_count"), levels.alias("levels"), F.max(level_rank(F.col("level"))).alias("rank"))


def layers(moves: DataFrame, *order: str) -> DataFrame:
    """(host, layer) of movements in the order of given columns: breadth-first distance from the source of the first one.

    Hosts that are never reached get a further layer each, in the order in which they first appear (in one movement the source
    before the target). Columns of `order` that tie are settled by the hosts' names. Each round is stored.
    """
    end = lambda n, host: F.struct(F.lit(n).alias("end"), F.col(host).alias("host"))
    ends = F.array(end(0, "SourceHost"), end(1, "TargetHost"))
    met = moves.select(F.struct(*order, "SourceHost", "TargetHost").alias("at"), F.explode(ends).alias("e"))
    hosts = stored(met.where("e.host is not null").groupBy("e.host").agg(F.min(F.struct("at", "e.end")).alias("first")))
    pairs = stored(moves.select("SourceHost", "TargetHost").dropna().distinct())
    seen = hosts.orderBy("first").limit(1).select("host", F.lit(0).alias("layer"))
    front, n = stored(seen), 0
    seen = front
    while not front.isEmpty():
        n += 1
        front = pairs.join(front.select("host"), pairs.SourceHost == F.col("host")).select(F.col("TargetHost").alias("host")).distinct()
        front = stored(front.join(seen, "host", "left_anti").withColumn("layer", F.lit(n)))
        seen = stored(seen.union(front))
    rest = ranges.numbered(hosts.join(seen, "host", "left_anti"), "nth", F.col("first"))
    return seen.union(rest.select("host", (F.col("nth") + (n - 1)).cast("int").alias("layer")))
