"""Accounting tables: nested JSON as analysts' tools write it, and a versioned store that replaces tables whole.

A table of the store is a folder with `data/<name>`, one folder of Parquet files for each write, and `commits/<number>`,
small files that name the data of each version. Readers take the highest commit. A writer says which version it has read;
its own commit is the next number, and creating a file that must not exist yet lets one writer alone have it. Data without a commit is
seen by nobody, so a writer that fails leaves the last version as it was.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = "struct<record_id:string, computer:string, channel:string>"
_GROUP = "struct<key:map<string,string>, count:bigint, verdict:string, note:string>"
_EVIDENCE = f"struct<refs:array<{_REF}>, record_ids:array<string>, detail_excerpt:string>"
# File, list in it and fields of each accounting table.
TABLES = {
    "rules": (
        "rule_triage.json",
        "rules",
        f"rule_title string, levels map<string,bigint>, count bigint, status string, verdict string, rationale string, evidence {_EVIDENCE}, "
        f"variants struct<fields:array<string>, groups:array<{_GROUP}>>, verified_at string",
    ),
    "clusters": ("clusters.json", "clusters", "id string, start string, end string, verdict string, note string, manual boolean"),
    "findings": (
        "findings.json",
        "findings",
        f"id string, title string, phase string, hosts array<string>, rule_titles array<string>, refs array<{_REF}>, record_ids array<string>, "
        "summary string, query string, created_at string",
    ),
    "iocs": ("iocs.json", "iocs", f"type string, value string, hosts array<string>, context string, refs array<{_REF}>, record_ids array<string>, created_at string"),
    "hosts": ("hosts.json", "hosts", "name string, status string, note string, updated_at string"),
    "environment": ("environment.json", "entries", "value string, category string, status string, source string, note string, recorded_at string"),
}


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one has read."""


def read_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of an accounting table, one for each entry of its JSON list; a missing file or list has none."""
    file, field, ddl = TABLES[name]
    try:
        whole = spark.read.schema(f"`{field}` array<struct<{ddl}>>").option("multiLine", True).json(f"{folder}/{file}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)
    return whole.select(F.inline(field))


def refs_of(table: DataFrame, owner: str, column: str = "refs") -> DataFrame:
    """(owner, record_id, computer, channel): a row for each reference of a table's entries."""
    return table.select(F.col(owner).alias("owner"), F.explode(column).alias("r")).select("owner", "r.record_id", "r.computer", "r.channel")


def variants_of(rules: DataFrame) -> DataFrame:
    """(rule_title, variant, count, verdict): the declared variants, their keys in the order of the rule's fields."""
    key = F.array_join(F.transform("variants.fields", lambda f: F.coalesce(F.element_at("g.key", f), F.lit(""))), "|")
    return rules.select("rule_title", "variants", F.explode("variants.groups").alias("g")).select("rule_title", key.alias("variant"), "g.count", "g.verdict")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, path: str) -> int:
    """The number of a table's last version; 0 before the first one."""
    return max(_commits(spark, path), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the last one unless another is named; earlier versions stay readable."""
    version = current(spark, path) if version is None else version
    fs, commit = _files(spark, f"{path}/commits/{version:010d}")
    if not fs.exists(commit):
        raise ValueError(f"{path} has no version {version}")
    named = spark.read.text(f"{path}/commits/{version:010d}").first()
    if named is None or not named.value.endswith("."):
        raise Conflict(f"the writer of version {version} of {path} has not finished; where it is gone for good, remove its commit")
    return spark.read.parquet(f"{path}/data/{named.value[:-1]}")


def write_version(df: DataFrame, path: str, base: int) -> int:
    """Write a table whole as the version after `base`, the one that the writer has read, and return its number.

    Conflict where another version was committed meanwhile, before or while the data was written; its data is then the last,
    and nothing of this write is seen. On stores whose creation of files is not exclusive, writers have to take turns.
    """
    spark = df.sparkSession
    if current(spark, path) != base:
        raise Conflict(f"{path} is at version {current(spark, path)}, not {base}")
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    fs, commit = _files(spark, f"{path}/commits/{base + 1:010d}")
    try:
        out = fs.create(commit, False)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise Conflict(f"version {base + 1} of {path} was committed by another writer") from e
    try:
        out.write(bytearray(f"{name}.\n".encode()))
    finally:
        out.close()
    return base + 1
