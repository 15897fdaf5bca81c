"""A detection log derived from the events table, and its DuckDB form for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event and matching rule; every column is a string."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return e.select(
        F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') || ' +00:00'").alias("Timestamp"),
        F.expr("'Rule ' || event_type || '-' || k % 4").alias("RuleTitle"),
        F.expr("CASE WHEN value >= 150 THEN 'crit' WHEN value >= 90 THEN 'high' WHEN value >= 40 THEN 'med' WHEN value >= 10 THEN 'low' ELSE 'info' END").alias("Level"),
        F.expr("'HOST-' || user_id % 20").alias("Computer"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'Sec' WHEN 1 THEN 'Sysmon' ELSE 'PowerShell' END").alias("Channel"),
        F.expr("CASE event_type WHEN 'click' THEN '4688' WHEN 'error' THEN '4104' WHEN 'purchase' THEN '7045' WHEN 'signup' THEN '4624' ELSE '1' END").alias("EventID"),
        F.expr("CASE event_type WHEN 'click' THEN 'Exec' WHEN 'error' THEN 'Exec ¦ Evas' WHEN 'purchase' THEN 'Persis ¦ LatMov' WHEN 'signup' THEN 'CredAccess' END").alias("MitreTactics"),
        F.expr("CASE event_type WHEN 'click' THEN 'T1059' WHEN 'error' THEN 'T1059.001 ¦ T1027' WHEN 'purchase' THEN 'T1543 ¦ T1021' WHEN 'signup' THEN 'T1003' END").alias("MitreTags"),
        F.expr("CAST(event_id % 7000 AS string)").alias("RecordID"),
        F.expr(
            "CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Cmdline: powershell.exe -enc ' || base64(encode('cmd' || k, 'UTF-16LE')) || ' ¦ User: user' || user_id "
            "WHEN event_type = 'view' THEN NULL "
            "ELSE 'Proc: C:~tmp~tool' || k || '.exe ¦ TgtUser: user' || user_id || ' ¦ SrcIP: 10.0.' || user_id % 8 || '.' || k END"
        ).alias("Details"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'Hashes: SHA256=' || k || ' ¦ Svc: svc' || k % 7 END").alias("ExtraFieldInfo"),
    )


LOGS_SQL = r"""
logs AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' +00:00' AS "Timestamp",
    'Rule ' || event_type || '-' || (k % 4) AS RuleTitle,
    CASE WHEN value >= 150 THEN 'crit' WHEN value >= 90 THEN 'high' WHEN value >= 40 THEN 'med' WHEN value >= 10 THEN 'low' ELSE 'info' END AS Level,
    'HOST-' || (user_id % 20) AS Computer,
    CASE user_id % 3 WHEN 0 THEN 'Sec' WHEN 1 THEN 'Sysmon' ELSE 'PowerShell' END AS Channel,
    CASE event_type WHEN 'click' THEN '4688' WHEN 'error' THEN '4104' WHEN 'purchase' THEN '7045' WHEN 'signup' THEN '4624' ELSE '1' END AS EventID,
    CASE event_type WHEN 'click' THEN 'Exec' WHEN 'error' THEN 'Exec ¦ Evas' WHEN 'purchase' THEN 'Persis ¦ LatMov' WHEN 'signup' THEN 'CredAccess' END AS MitreTactics,
    CASE event_type WHEN 'click' THEN 'T1059' WHEN 'error' THEN 'T1059.001 ¦ T1027' WHEN 'purchase' THEN 'T1543 ¦ T1021' WHEN 'signup' THEN 'T1003' END AS MitreTags,
    CAST(event_id % 7000 AS VARCHAR) AS RecordID,
    CASE WHEN event_type = 'error' AND k % 2 = 0
           THEN 'Cmdline: powershell.exe -enc ' || to_base64(encode(regexp_replace('cmd' || k, '(.)', '\1' || chr(0), 'g'))) || ' ¦ User: user' || user_id
         WHEN event_type = 'view' THEN NULL
         ELSE 'Proc: C:~tmp~tool' || k || '.exe ¦ TgtUser: user' || user_id || ' ¦ SrcIP: 10.0.' || (user_id % 8) || '.' || k END AS Details,
    CASE WHEN k % 5 = 0 THEN 'Hashes: SHA256=' || k || ' ¦ Svc: svc' || (k % 7) END AS ExtraFieldInfo
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
)"""
