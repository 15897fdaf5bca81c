"""Filters and keyword search over timelines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.logs import existing

# Folders in which tools are staged.
STAGING = ["C:\\Users\\Public\\", "C:\\ProgramData\\", "C:\\Windows\\Temp\\", "C:\\Perflogs\\"]


def by_level(df: DataFrame, *levels: str) -> DataFrame:
    return df.where(F.col("Level").isin(*levels)) if levels else df


def holds(column: str, text: str) -> Column:
    """Case-sensitive substring; a null column holds nothing but the empty text."""
    return F.coalesce(F.col(column), F.lit("")).contains(text)


def by_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive bounds compared as text, so an end that is a bare day leaves that day's rows out."""
    if start:
        df = df.where(F.col("Timestamp") >= start)
    return df.where(F.col("Timestamp") <= end) if end else df


def lateral_default(df: DataFrame) -> DataFrame:
    return df.where(F.col("Level").isin("high", "crit") | holds("MitreTactics", "LatMov"))


def record(df: DataFrame, record_id: str, computer: str | None = None, channel: str | None = None, rule: str | None = None) -> DataFrame:
    for column, value in (("RecordID", record_id), ("Computer", computer), ("Channel", channel), ("RuleTitle", rule)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def first_where(df: DataFrame, condition: str) -> DataFrame:
    """The first row that meets a SQL condition, in the order of all columns, nulls last."""
    return df.where(condition).orderBy(*[F.asc_nulls_last(c) for c in df.columns]).limit(1)


def with_detail(df: DataFrame, column: str = "Details") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def without_placeholders(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.col(column).isin("", "-", "N/A"))


def window_sample(df: DataFrame, clusters: DataFrame, rows: int = 20) -> DataFrame:
    """The first high or critical rows of each cluster (id, start, end)."""
    day = F.to_date(F.substring("Timestamp", 1, 10))
    inside = by_level(df, "high", "crit").withColumn("day", day).join(F.broadcast(clusters), (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("end")))
    order = Window.partitionBy("id").orderBy("Timestamp", "RuleTitle", "Computer", "RecordID", "Channel")
    return inside.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("id", "nth", "Timestamp", "RuleTitle", "Computer", "RecordID")


def staged(df: DataFrame, column: str = "Details", folders: list[str] = STAGING) -> DataFrame:
    return df.where(reduce(or_, [F.col(column).contains(x) for x in folders]))


def search(df: DataFrame, query: str, columns: list[str] | None = None, mode: str = "contains", case_sensitive: bool = False, hits: bool = True) -> DataFrame:
    """Rows of which some column matches; HitColumns names them in the order searched (sorted by default).

    prefix keeps % and _ as wildcards; regex without case folds the pattern, too.
    """
    columns = columns or sorted(df.columns)
    needle = query if case_sensitive else query.lower()

    def one(name: str) -> Column:
        c = F.col(name) if case_sensitive else F.lower(name)
        if mode == "contains":
            return F.instr(c, needle) > 0
        if mode == "exact":
            return c == needle
        if mode == "prefix":
            return c.like(needle.replace("\\", "\\\\") + "%")  # % and _ stay wildcards, a backslash is none
        if mode == "regex":
            return c.rlike(needle)
        raise ValueError(f"mode {mode!r}: use contains, exact, prefix or regex")

    found = {c: F.coalesce(one(c), F.lit(False)) for c in columns}
    out = df.where(reduce(or_, found.values()))
    return out.withColumn("HitColumns", F.concat_ws(", ", *[F.when(v, F.lit(c)) for c, v in found.items()])) if hits else out


def host_timeline(df: DataFrame, host: str = "", levels: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of hosts whose name holds a text, with those of the ten usual columns that the log has."""
    wanted = ["Timestamp", "RuleTitle", "Level", "Computer", "Channel", "EventID", "MitreTactics", "MitreTags", "Details", "AllFieldInfo"]
    out = by_time(by_level(df, *levels), start, end).where(holds("Computer", host))
    return out.select(existing(df, wanted))
