"""Reading detection timelines and accounting tables, and writing state."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = " ¦ "


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    """A timeline CSV: header, strings only, quoted line breaks kept; empty cells are null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def activate(df: DataFrame) -> DataFrame:
    """Make df the view `logs`, replacing any before it, and return its status."""
    df.createOrReplaceTempView("logs")
    return dataset_status(df)


def deactivate(spark: SparkSession) -> None:
    spark.catalog.dropTempView("logs")


def dataset_status(df: DataFrame, path: str = "") -> DataFrame:
    """One row: path, when it was asked for, rows, columns and their names."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(True).alias("loaded"), F.lit(path).alias("path"), F.current_timestamp().alias("loaded_at"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.array(*map(F.lit, df.columns)).alias("columns"))


def dataset_inventory(spark: SparkSession, root: str, pattern: str = "*.csv", recursive: bool = True, name_filter: str = "") -> DataFrame:
    """Datasets below a folder: alias, name, path, size in MB and time of change, by path.

    A dataset is a file, or a folder of files as Spark writes tables, whose name fits the pattern (with * and ?). A folder that fits is
    one dataset, as large as its files together and changed with the last of them; what lies in it is not listed by itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    start = F.locate(f"/{base}/", F.col("path")) + (len(base) + 2) if base else F.lit(1)
    parts = F.split(F.col("path").substr(start, F.length("path")), "/")
    fits = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    # The first part below the root that fits names the dataset.
    depth = F.array_position(F.transform(parts, lambda p: p.rlike(f"^{fits}$")), True)
    found = files.select(parts.alias("parts"), depth.alias("depth"), start.alias("start"), "*").where("depth > 0" if recursive else "depth = 1")
    inside = F.array_join(F.slice("parts", 1, F.col("depth").cast("int")), "/")
    found = found.select(F.concat(F.col("path").substr(F.lit(1), F.col("start") - 1), inside).alias("path"), "length", "modificationTime")
    whole = found.groupBy("path").agg(F.round(F.sum("length") / 1048576, 2).alias("size_mb"), F.max("modificationTime").alias("modified_at"))
    name = F.element_at(F.split("path", "/"), -1)
    return (
        whole.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("alias"), name.alias("name"), "path", "size_mb", "modified_at")
        .where(F.lower("name").contains(name_filter.lower()))
        .orderBy(F.lower("path"))
    )


def resolve_detail_source(df: DataFrame, name: str | None = None) -> str:
    """The detail column to use: the named one, whatever its case, or AllFieldInfo where present, else Details."""
    choices = {c.lower(): c for c in ("Details", "AllFieldInfo")}
    if name is None:
        return "AllFieldInfo" if "AllFieldInfo" in df.columns else "Details"
    column = choices.get(name.lower())
    if column is None:
        raise ValueError(f"detail source {name!r}: use one of {', '.join(choices.values())}")
    if column not in df.columns:
        other = next(c for c in choices.values() if c != column)
        raise ValueError(f"there is no column {column}; try {other}")
    return column


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that df has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def fingerprint(df: DataFrame, ts_total: str = "Timestamp") -> DataFrame:
    """Order-free fingerprint of all rows with its algorithm, row count and timestamp coverage."""
    from ..functions.timestamps import lenient

    # Nulls are hashed as such, and repeated rows add up: sums do not cancel as an exclusive or would.
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.agg(
        F.lit("sum(xxhash64)x2").alias("algorithm"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.concat_ws("-", *[F.sum(h.cast("decimal(20,0)")) for h in (F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells))]).alias("value"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(ts_total) != "").alias("ts_total"),
        F.count(lenient(F.col(ts_total))).alias("ts_parsed"),
    )


def fingerprint_parts(df: DataFrame, by: str, parts: int = 64) -> DataFrame:
    """(name, part, rows, value, algorithm, columns): an order-free digest of each part of each named portion of a table, files for one.

    A row's part follows from its content, so a table of any size is compared part by part, and one that changed is found without
    reading the others. The values of a portion's parts add up to that of the portion.
    """
    columns = [c for c in df.columns if c != by]
    cells = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashes = [F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)]
    keyed = df.select(F.col(f"`{by}`").cast("string").alias("name"), *(h.alias(f"h{i}") for i, h in enumerate(hashes)))
    sums = [F.sum(F.col(f"h{i}").cast("decimal(20,0)")).cast("string") for i in range(2)]
    out = keyed.groupBy("name", F.pmod("h0", F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *sums).alias("value"))
    return out.withColumns({"algorithm": F.lit(f"sum(xxhash64)x2/{parts}"), "columns": F.lit(",".join(columns))})


def file_parts(spark: SparkSession, path: str, parts: int = 64) -> DataFrame:
    """fingerprint_parts of the lines of the files below a path, whatever their size; the line break is not part of a line."""
    return fingerprint_parts(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), "file", parts)


def changed_parts(told: DataFrame, found: DataFrame) -> DataFrame:
    """(name, part, state) of the parts in which two tables of parts differ: missing (the whole portion is), new (likewise), changed, or
    other digest where they were made by another algorithm or of other columns; missing and new ones have no part."""
    both = told.alias("t").join(found.alias("f"), ["name", "part"], "full_outer")
    names = lambda df, c: df.select("name", F.lit(True).alias(c)).distinct()
    both = both.join(names(told, "was"), "name", "left").join(names(found, "now"), "name", "left")
    same = F.col("t.value").eqNullSafe(F.col("f.value"))
    alike = (F.col("t.algorithm") == F.col("f.algorithm")) & (F.col("t.columns") == F.col("f.columns"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(~F.coalesce(alike, F.lit(True)), "other digest").when(~same, "changed")
    out = both.select("name", F.when(F.col("now") & F.col("was"), F.col("part")).alias("part"), state.alias("state"))
    return out.where("state IS NOT NULL").distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good and bad records of a JSON-lines log; lines that are no objects are bad, not fatal; a missing file is an empty log."""
    whole = f"{schema}, _corrupt_record string"
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    lines = lines.where(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull() & F.ltrim("value").startswith("{")
    return rows.where(good).select("r.*").drop("_corrupt_record"), rows.where(~good).select(F.col("value").alias("_corrupt_record"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file under a path, for files below 2 GB; larger ones have the fingerprint of their rows."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
