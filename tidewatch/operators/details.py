"""Operators over the key-value pairs of detail fields, and encoded commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import details as D
from ..functions.timestamps import strict
from ..plans.free_sql import ask_sql
from ..sources.logs import SEPARATOR, resolve_detail_source
from ..sources.shared import stored
from .filters import by_level, holds, record, with_detail, without_placeholders


def exploded(df: DataFrame, column: str = "Details", key: str | None = None) -> DataFrame:
    """One row per pair: df's columns with key and value. Rows without the key's text are left out first."""
    rows = with_detail(df, column)
    if key:
        rows = rows.where(F.col(column).contains(key + ": "))
    rows = rows.withColumn("pair", F.explode(D.pairs(F.col(column)))).where(F.instr("pair", ": ") > 0)
    rows = rows.withColumns({"key": D.pair_key(F.col("pair")), "value": D.pair_value(F.col("pair"))}).drop("pair")
    return rows.where(F.col("key") == key) if key else rows


def key_counts(df: DataFrame, column: str = "Details") -> DataFrame:
    return exploded(df, column).groupBy("key").agg(F.count(F.lit(1)).alias("count"))


def values(df: DataFrame, key: str, column: str = "Details") -> DataFrame:
    """Every value of a key with its row's time, host, rule and level; empty values stay."""
    return exploded(df, column, key).select("value", "Timestamp", "Computer", "RuleTitle", "Level")


def unique_values(df: DataFrame, key: str, column: str = "Details") -> DataFrame:
    rows = exploded(df, column, key).where("value <> ''")
    return rows.groupBy("value").agg(D.ordered_set(F.col("Computer")).alias("hosts"), F.count(F.lit(1)).alias("count"))


def _narrowed(df: DataFrame, levels: tuple[str, ...], rule: str) -> DataFrame:
    return by_level(df, *levels).where(holds("RuleTitle", rule)) if rule else by_level(df, *levels)


def extract_iocs(df: DataFrame, kind: str | None = None, source: str = "Details", levels: tuple[str, ...] = (), rule: str = "") -> DataFrame:
    """Indicators by category: Type, FieldName, Value, Hosts, Count.

    Rows without the detail column are skipped, also those with ExtraFieldInfo alone, which goes with Details.
    Keys are those of the column's profile; levels and a part of the rule's title narrow the rows.
    """
    source = resolve_detail_source(df, source)
    both, kinds = F.col(source), D.IOC_KEYS if source == "Details" else D.ALL_FIELD_IOC_KEYS
    if source == "Details" and "ExtraFieldInfo" in df.columns:
        both = F.when(F.coalesce("ExtraFieldInfo", F.lit("")) != "", F.concat_ws(SEPARATOR, "Details", "ExtraFieldInfo")).otherwise(both)
    types = F.create_map(*[F.lit(x) for t, keys in kinds.items() for k in keys for x in (k, t)])
    rows = with_detail(_narrowed(df, levels, rule), source).select("Computer", F.explode(D.pairs(both)).alias("pair")).where(F.instr("pair", ": ") > 0)
    rows = rows.select("Computer", D.pair_key(F.col("pair")).alias("FieldName"), D.ioc_value(F.col("pair")).alias("Value"))
    rows = without_placeholders(rows.withColumn("Type", F.element_at(types, F.col("FieldName"))).where("Type is not null"), "Value")
    if kind:
        rows = rows.where(F.col("Type") == kind)
    return rows.groupBy("Type", "FieldName", "Value").agg(D.ordered_set(F.col("Computer")).alias("Hosts"), F.count(F.lit(1)).alias("Count"))


def variant_of(df: DataFrame, keys: list[str], column: str = "Details") -> DataFrame:
    """df with variant: its fields (columns where they exist, else detail keys, missing as '') joined by '|'.

    A '|' or backslash that stands in a field is written with a backslash before it.
    """
    parsed = df.withColumn("__m", D.detail_map(F.col(column)))
    of = [F.coalesce(F.col(k) if k in df.columns else F.try_element_at("__m", F.lit(k)), F.lit("")) for k in keys]
    return parsed.withColumn("variant", F.concat_ws("|", *[F.regexp_replace(v, r"([\\|])", r"\\$1") for v in of])).drop("__m")


def variants_by_rule(df: DataFrame, fields: DataFrame, column: str = "Details") -> DataFrame:
    """Rows of the rules that `fields` (rule_title, fields) names, with variant: the values of the rule's own fields, as in variant_of.

    A field that is a column with a value is that value, trimmed; else it is the detail key of that name, else ''.
    """
    held = df.join(fields.select(F.col("rule_title").alias("RuleTitle"), F.col("fields").alias("__fields")), "RuleTitle")
    cells = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.trim(F.col(c)))])
    both = F.array(F.struct(cells.alias("cells"), D.detail_map(F.col(column)).alias("pairs")))  # worked out once a row

    def value(m: Column, f: Column) -> Column:
        found = F.coalesce(F.try_element_at(m["cells"], f), F.try_element_at(m["pairs"], f), F.lit(""))
        return F.regexp_replace(found, r"([\\|])", r"\\$1")

    named = F.transform(both, lambda m: F.array_join(F.transform("__fields", lambda f: value(m, f)), "|"))[0]
    return held.withColumn("variant", named).drop("__fields")


def variants(df: DataFrame, keys: list[str], column: str = "Details", most: int = 2_000) -> DataFrame:
    """Rows per rule and tuple of fields, and whether a rule has too many of them."""
    out = variant_of(df, keys, column).groupBy("RuleTitle", "variant").agg(F.count(F.lit(1)).alias("count"))
    over = out.groupBy("RuleTitle").agg((F.count(F.lit(1)) > most).alias("overflow"))
    return out.join(over, "RuleTitle")


def diversity(df: DataFrame, probes: list[str], column: str = "Details", by: tuple[str, ...] = ("RuleTitle",)) -> DataFrame:
    """Distinct values of probe keys per rule (or other columns), empty ones aside, and whether they are more than three."""
    rows = exploded(df, column).where(F.col("key").isin(*probes) & (F.col("value") != ""))
    return rows.groupBy(*by, "key").agg(F.countDistinct("value").alias("distinct_values")).withColumn("diverse", F.col("distinct_values") > 3)


def account_impact(df: DataFrame, column: str = "Details") -> DataFrame:
    rows = exploded(df, column).where(F.col("key").isin(*D.IOC_KEYS["user"]) & (F.col("value") != ""))
    return rows.groupBy("value").agg(D.ordered_set(F.col("Computer")).alias("hosts"), F.countDistinct("Computer").alias("host_count"), F.count(F.lit(1)).alias("count"), D.ordered_set(F.col("RuleTitle")).alias("rules"))


def account_spread(df: DataFrame) -> DataFrame:
    return account_impact(df).where("host_count > 1").select("value", "hosts", "count")


def hashes(df: DataFrame, column: str = "ExtraFieldInfo") -> DataFrame:
    rows = exploded(df, column).where("key = 'Hashes'").withColumn("h", F.explode(F.split("value", ",")))
    rows = rows.select("Computer", F.substring_index("h", "=", 1).alias("algorithm"), F.expr("substring(h, instr(h, '=') + 1)").alias("hash"))
    return rows.groupBy("algorithm", "hash").agg(D.ordered_set(F.col("Computer")).alias("hosts"), F.count(F.lit(1)).alias("count"))


def ip_hosts(df: DataFrame, column: str = "Details") -> DataFrame:
    ips = F.regexp_extract_all(column, F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1))
    return df.select("Computer", F.explode(ips).alias("ip")).distinct()


def sid_accounts(df: DataFrame, column: str = "Details") -> DataFrame:
    """Accounts named in rows that mention a security id."""
    sids = F.regexp_extract_all(column, F.lit(r"\b(S-1-[0-9-]+)\b"), F.lit(1))
    rows = exploded(df.withColumn("sids", sids), column).where(F.col("key").isin(*D.IOC_KEYS["user"]))
    return rows.select(F.explode("sids").alias("sid"), "value").groupBy("sid").agg(D.ordered_set(F.col("value")).alias("accounts"))


def processes(df: DataFrame, keys: tuple[str, ...] = ("PID", "PGUID"), column: str = "Details") -> DataFrame:
    """Process values on a host that more than one rule hit."""
    rows = exploded(df, column).where(F.col("key").isin(*keys))
    return rows.groupBy("Computer", "value").agg(F.countDistinct("RuleTitle").alias("rules"), F.count(F.lit(1)).alias("count")).where("rules > 1")


def _named(prefix: str):
    return lambda p: F.struct(F.concat(F.lit(prefix + "."), D.pair_key(p)).alias("Field"), D.pair_value(p).alias("Value"))


def expand_events(df: DataFrame) -> DataFrame:
    """(key columns, Field, Value): every column and every pair of the detail fields; '._raw' where there is no pair."""
    names = {"Details": "Details", "ExtraFieldInfo": "Extra", "AllFieldInfo": "AllField"}
    ids = [c for c in ("RecordID", "Computer", "Channel", "RuleTitle") if c in df.columns]
    plain = [c for c in df.columns if c not in names]
    entries = [F.array(F.struct(F.lit(c).alias("Field"), F.col(c).alias("Value"))) for c in plain]
    for c, prefix in names.items():
        if c in df.columns:
            kept = F.filter(D.pairs(F.col(c)), lambda p: F.instr(p, ": ") > 0)
            raw = F.array(F.struct(F.lit(prefix + "._raw").alias("Field"), F.col(c).alias("Value")))
            each = F.transform(kept, _named(prefix))
            entries.append(F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<struct<Field:string,Value:string>>")).when(F.size(kept) == 0, raw).otherwise(each))
    rows = df.select(*[F.col(c).alias("Key" + c) for c in ids], F.explode(F.concat(*entries)).alias("e"))
    return rows.select(*["Key" + c for c in ids], F.col("e.Field").alias("Field"), F.col("e.Value").alias("Value"))


def candidates(df: DataFrame, most: int = 5) -> DataFrame:
    """(status, RecordID, Computer, Channel, Timestamp, RuleTitles, MatchedRows): one row for each event of the rows given.

    An event is a record id on a host and channel, nulls and empty ones alike; its first rules are listed by name, with dots where there are more, and its
    time is that of its first row by rule and time.
    """
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("Computer", "Channel")]
    titles = F.array_sort(F.collect_set("RuleTitle"))  # the rules that one event hit
    first = F.min_by("Timestamp", F.struct("RuleTitle", "Timestamp"))
    out = df.groupBy("RecordID", *keys).agg(first.alias("Timestamp"), titles.alias("t"), F.count(F.lit(1)).alias("MatchedRows"))
    listed = F.concat(F.array_join(F.slice("t", 1, most), ", "), F.when(F.size("t") > most, " ...").otherwise(""))
    return out.select(F.lit("ambiguous").alias("status"), "RecordID", "Computer", "Channel", "Timestamp", listed.alias("RuleTitles"), "MatchedRows")


def get_event_detail(df: DataFrame, record_id: str = "", computer: str = "", channel: str = "", rule: str = "", sql_filter: str = "") -> DataFrame:
    """One event, named by its record id (and host, channel, rule) or by a condition, as (status, Field, Value).

    Where several events have the id, their `candidates` come back instead; where none has, a row with status no_data. The
    condition is SQL over the columns of logs, checked like free SQL; the first row in the order of host, channel, rule and time that
    meets it is the event.
    """
    told, condition = record_id.strip(), sql_filter.strip()
    if bool(told) == bool(condition):
        raise ValueError("give either a record id or a condition")
    if condition and (computer.strip() or channel.strip() or rule.strip()):
        raise ValueError("host, channel and rule go with a record id; put them into the condition")
    nothing = df.sparkSession.createDataFrame([("no_data", None, None)], "status string, Field string, Value string")
    order = [F.asc_nulls_last(c) for c in ("Computer", "Channel", "RuleTitle", "Timestamp") if c in df.columns]
    if condition:
        rows = ask_sql(df, f"SELECT * FROM logs WHERE (\n{condition}\n)").rows
        one = rows.orderBy(*order, *[F.asc_nulls_last(c) for c in df.columns]).limit(1)
        out = expand_events(one).select(F.lit("found").alias("status"), "Field", "Value")
        return nothing if one.isEmpty() else out
    rows = record(df, told, *(x.strip() or None for x in (computer, channel, rule)))
    found = candidates(rows)
    n = found.limit(2).count()
    return nothing if n == 0 else found if n > 1 else event_detail(rows, told)


def event_detail(df: DataFrame, record_id: str, computer: str | None = None, channel: str | None = None, rule: str | None = None) -> DataFrame:
    """(status, Field, Value) of one event: its columns and pairs, and where several rules hit it, how many rows and which rules.

    Where several events fit, status is ambiguous and each candidate is a row (host/channel, its rules); no event gives no row.
    """
    rows = record(df, record_id, computer, channel, rule)
    key = F.struct(F.coalesce("Computer", F.lit("")).alias("c"), F.coalesce("Channel", F.lit("")).alias("ch"))
    titles = F.array_sort(F.collect_set("RuleTitle"))
    events, n, every = rows.agg(F.countDistinct(key), F.count(F.lit(1)), F.array_join(titles, ", ")).first()  # three values of one event
    if events > 1:
        many = rows.groupBy(key.alias("k")).agg(F.array_join(F.slice(titles, 1, 5), ", ").alias("Value"))
        return many.select(F.lit("ambiguous").alias("status"), F.concat_ws("/", "k.c", "k.ch").alias("Field"), "Value")
    one = expand_events(rows.orderBy(*[F.asc_nulls_last(c) for c in rows.columns]).limit(1)).select(F.lit("found").alias("status"), "Field", "Value")
    if n < 2:
        return one
    extra = df.sparkSession.createDataFrame([("found", "_MatchedRows", str(n)), ("found", "_MatchedRuleTitles", every)], "status string, Field string, Value string")
    return one.union(extra)


def event_ambiguity(df: DataFrame) -> DataFrame:
    """Per record id: distinct events (host, channel), matched rows and whether the id alone is ambiguous."""
    return df.groupBy("RecordID").agg(F.countDistinct(F.struct(F.coalesce("Computer", F.lit("")), F.coalesce("Channel", F.lit("")))).alias("events"), F.count(F.lit(1)).alias("matched_rows"), F.countDistinct("RuleTitle").alias("rules")).withColumn("ambiguous", F.col("events") > 1)


def _encoded(df: DataFrame, source: str, levels: tuple[str, ...], rule: str) -> DataFrame:
    """Rows whose text holds an encoded command, with the text as __text; a cheap pattern test goes before the extraction."""
    source = resolve_detail_source(df, source)
    text = F.concat_ws(" ", source, "ExtraFieldInfo") if source == "Details" and "ExtraFieldInfo" in df.columns else F.coalesce(source, F.lit(""))
    return _narrowed(df, levels, rule).withColumn("__text", text).where(D.has_encoded_command(F.col("__text")))


def _decoded(rows: DataFrame, shorten: bool) -> DataFrame:
    rows = rows.withColumn("operand", F.explode(D.encoded_commands(F.col("__text"))))
    text = D.escaped(D.decoded(F.col("operand")))
    return rows.select("Timestamp", "Computer", "RuleTitle", "Level", (D.shortened(F.col("operand")) if shorten else F.col("operand")).alias("EncodedCommand"), text.alias("DecodedCommand"))


def decode_commands(df: DataFrame, source: str = "Details", shorten: bool = True, levels: tuple[str, ...] = (), rule: str = "") -> DataFrame:
    """One row per encoded command with its text.

    ExtraFieldInfo is read with Details; AllFieldInfo stands alone. Nulls and empty texts give no row.
    """
    return _decoded(_encoded(df, source, levels, rule), shorten)


def decode_first(df: DataFrame, most: int = 5_000, source: str = "Details", shorten: bool = True, levels: tuple[str, ...] = (), rule: str = "") -> DataFrame:
    """decode_commands over the first `most` rows by time that hold a command, with what was left out disclosed on each row.

    source_event_count is the number of all rows that hold one, counted in the pass that finds the first ones; status is
    partial where there are more than were read. Where nothing is decoded, one row says no_data, or partial.
    """
    counted = Observation()
    rows = _encoded(df, source, levels, rule).select("Timestamp", "Computer", "RuleTitle", "Level", "__text")
    order = [strict(F.col("Timestamp")).asc_nulls_last(), *[F.asc_nulls_last(c) for c in rows.columns]]
    first = stored(rows.observe(counted, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(most))
    n = counted.get["n"]
    out = _decoded(first, shorten)
    status = "partial" if n > most else "ok"
    if out.isEmpty():
        status = "partial" if n > most else "no_data"
        out = df.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in out.columns])
    return out.withColumns({"status": F.lit(status), "source_event_count": F.lit(n)})
