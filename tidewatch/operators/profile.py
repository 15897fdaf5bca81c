"""Counts over timelines: profiles, summaries, windows and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.details import IOC_KEYS, level_rank, ordered_set, pair_key, pair_value, pairs
from ..functions.timestamps import as_text, lenient, local_day, strict
from ..sources.logs import SEPARATOR, require_columns
from .filters import by_level, by_time, holds

EMPTY = "(empty)"


def overview(df: DataFrame, path: str = "") -> DataFrame:
    """Metric rows: path, rows, columns, first and last timestamp, parsed timestamps."""
    one = df.agg(
        F.count(F.lit(1)).cast("string").alias("row_count"),
        F.min("Timestamp").alias("first_timestamp"),
        F.max("Timestamp").alias("last_timestamp"),
        F.count(strict(F.col("Timestamp"))).cast("string").alias("parsed_timestamps"),
    )
    cells = {"path": F.lit(path), "row_count": F.col("row_count"), "column_count": F.lit(str(len(df.columns)))}
    cells |= {c: F.col(c) for c in ("first_timestamp", "last_timestamp", "parsed_timestamps")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in cells.items()])))


def _labelled(c: str):
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(EMPTY))


def section(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values; null and '' stay two rows with one label."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).select(_labelled(column).alias("label"), "count").orderBy(F.desc("count"), "label").limit(top)


def profile_all(df: DataFrame, top: int = 20) -> DataFrame:
    """(section, metric, key, value) of the overview and of levels, computers and rules; here null and '' merge."""
    parts = [overview(df).where("metric <> 'path'").select(F.lit("overview").alias("section"), "metric", F.lit("").alias("key"), "value")]
    for name, column in (("levels", "Level"), ("computers", "Computer"), ("rules", "RuleTitle")):
        counted = df.groupBy(_labelled(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
        parts.append(counted.select(F.lit(name).alias("section"), F.lit("count").alias("metric"), "key", F.col("n").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def summarize(df: DataFrame, field: str = "RuleTitle", level: str | None = None, top: int = 100) -> DataFrame:
    """Rows by one of the columns, the most frequent first; a column that the log lacks is a ValueError that lists those it has."""
    require_columns(df, [field])
    return by_level(df, *([level] if level else [])).groupBy(field).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(field)).limit(top)


def by_window(df: DataFrame, width: str = "1 hour", levels: tuple[str, ...] = (), rule: str = "") -> DataFrame:
    """Rows per tumbling window; rows without a parsed time do not count."""
    rows = by_level(df, *levels).where(holds("RuleTitle", rule)).select(strict(F.col("Timestamp")).alias("ts")).where("ts is not null")
    return rows.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("count")).select(as_text(F.col("window.start")).alias("window_start"), "count")


def analyze_rule_titles(df: DataFrame, levels: tuple[str, ...] = (), min_count: int = 1, contains: str = "", start: str | None = None, end: str | None = None, top: int = 100) -> DataFrame:
    """Per rule: count, first and last sighting as text, its levels and hosts."""
    rows = by_time(by_level(df, *levels), start, end).where(holds("RuleTitle", contains))
    out = rows.groupBy("RuleTitle").agg(F.count(F.lit(1)).alias("count"), F.min("Timestamp").alias("first_seen"), F.max("Timestamp").alias("last_seen"), ordered_set(F.col("Level")).alias("levels"), ordered_set(F.col("Computer")).alias("hosts"))
    return out.where(F.col("count") >= min_count).orderBy(F.desc("count"), F.asc_nulls_last("RuleTitle")).limit(top)


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Per value of a column: total and a map of counts per level (trimmed, lower case); empty values do not count."""
    counted = df.where(F.col(column) != "").groupBy(column, F.lower(F.trim("Level")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(column).agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels"))


def timestamp_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("Timestamp") != "").alias("ts_total"), F.count(lenient(F.col("Timestamp"))).alias("ts_parsed"))


def default_levels(df: DataFrame) -> DataFrame:
    """high and crit where there are any, else med, else all there are."""
    held = df.agg(F.array_sort(F.collect_set(F.lower(F.trim("Level")))).alias("l"))
    top = F.array_intersect(F.lit(["crit", "high"]), F.col("l"))
    return held.select(F.when(F.size(top) > 0, F.lit(["crit", "high"])).when(F.array_contains("l", "med"), F.lit(["med"])).otherwise(F.col("l")).alias("levels"))


def host_impact(df: DataFrame) -> DataFrame:
    """Hosts with high or critical rows: counts, rules, first and last sighting, and what that suggests."""
    crit, high = F.count_if(F.col("Level") == "crit"), F.count_if(F.col("Level") == "high")
    out = df.groupBy("Computer").agg(crit.alias("crit"), high.alias("high"), F.min("Timestamp").alias("first_seen"), F.max("Timestamp").alias("last_seen"), ordered_set(F.when(F.col("Level").isin("crit", "high"), F.col("RuleTitle"))).alias("rules"))
    return out.withColumn("status", F.when(F.col("crit") > 0, "Confirmed").when(F.col("high") > 0, "Suspected").otherwise("Under Investigation"))


def host_rank(df: DataFrame) -> DataFrame:
    """Hosts by critical rows, lateral movement, first high or critical row and tactics."""
    return df.groupBy("Computer").agg(
        F.count_if(F.col("Level") == "crit").alias("crit"),
        F.coalesce(F.max(holds("MitreTactics", "LatMov")), F.lit(False)).alias("lateral"),
        F.min(F.when(F.col("Level").isin("high", "crit"), F.col("Timestamp"))).alias("first_high"),
        F.size(F.array_remove(F.array_distinct(F.flatten(F.collect_set(F.split("MitreTactics", SEPARATOR)))), "")).cast("long").alias("tactics"),
    ).orderBy(F.desc("crit"), F.desc("lateral"), F.asc_nulls_last("first_high"), F.desc("tactics"), "Computer")


def incident_overview(df: DataFrame) -> DataFrame:
    """One row: period, rows in all and per level, hosts, accounts (distinct values of user keys), and the first of the most severe rows."""
    pair = F.explode(pairs(F.col("Details")))
    users = df.select(pair.alias("p")).where(pair_key(F.col("p")).isin(*IOC_KEYS["user"])).select(pair_value(F.col("p")).alias("v")).where("v <> ''")
    accounts = users.distinct().count()
    counts = [F.count_if(F.col("Level") == x).alias(x) for x in ("crit", "high", "med", "low", "info")]
    top = F.min(F.struct((-level_rank(F.col("Level"))).alias("r"), "Timestamp", "RuleTitle", "Computer"))
    one = df.agg(F.min("Timestamp").alias("first_seen"), F.max("Timestamp").alias("last_seen"), F.count(F.lit(1)).alias("events"), *counts, F.countDistinct("Computer").alias("host_count"), ordered_set(F.col("Computer")).alias("hosts"), F.lit(accounts).alias("account_count"), top.alias("t"))
    return one.select("*", F.col("t.Timestamp").alias("top_time"), F.col("t.RuleTitle").alias("top_rule"), F.col("t.Computer").alias("top_host")).drop("t")


def active_days(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The days of rows at given levels, in any case and with blanks around them; no level given means all rows."""
    held = df.where(F.lower(F.trim("Level")).isin(*levels)) if levels else df
    return held.select(local_day(F.col("Timestamp")).alias("day")).where("day is not null").distinct()
