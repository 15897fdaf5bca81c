"""Accounting of analysts' verdicts against the log: references, votes, variants and the gates G0 to G11.

Tables: rules (rule_title, levels array<string>, count, status, verdict, rationale, excerpt), refs (owner,
rule_title, record_id, computer, channel), findings (id, rule_title, host), hosts (name), clusters (id,
verdict), queries (seq, query_hash, has_more, accepted), votes (target, verdict), groups (rule_title,
variant, count, verdict). Every gate is one row (id, name, status, detail, gaps, n_gaps).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.details import squeezed
from ..functions.matching import occurring
from ..sources.logs import changed_parts
from ..sources.shared import stored
from .details import diversity, variants, variants_by_rule
from .profile import overview

VOLUME = 20
#: Gaps that a gate's row lists.
GAPS = 10
# What a variant without an attack is called; the longer name stands for it, too.
BENIGN = ["benign", "false_positive"]

def gate(gaps: DataFrame, gap: Column, number: int, name: str, note: str = "", most: int = GAPS) -> DataFrame:
    """PASS where there is no gap; n_gaps counts the distinct ones, and the first few are listed in order.

    Of the gaps only their number and the first ones are gathered, so a gate's row is small however many there are. A note is added
    to the detail and changes nothing.
    """
    each = gaps.select(gap.alias("gap")).where("gap IS NOT NULL").distinct()
    parts = each.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast("string").alias("gap"))
    parts = parts.union(each.orderBy("gap").limit(most).select(F.lit(0).cast("long"), "gap"))
    one = parts.agg(F.sum("n").alias("n_gaps"), F.array_sort(F.collect_list("gap")).alias("gaps"))  # so many rows and one more
    return one.select(
        F.lit(f"G{number}").alias("id"),
        F.lit(name).alias("name"),
        F.when(F.col("n_gaps") > 0, "FAIL").otherwise("PASS").alias("status"),
        F.concat(F.col("n_gaps").cast("string"), F.lit(f" gaps{'; ' * bool(note)}{note}")).alias("detail"),
        "gaps",
        "n_gaps",
    )


def resolve_refs(refs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each reference with its state: not_found, ambiguous (several events have the id), ambiguous_channels (its host is named, but
    not which of several channels), wrong_rule or ok; found: its row's host. A reference without a rule asks for no rule.

    The channel counts only where the host is given, too. An empty host or channel of a reference is as none;
    nulls of the log are values of their own, so an event without a host or channel is still an event.

    What the log says of a record id, of its rows on a host, and of those in a channel there is counted once for each of the three; a
    reference meets one row of counts and one of its rule, so no pairs of a reference and the rows with its id are made.

    The distinct rows with an id that is asked for are stored, so the log is read once; hosts are counted from channels and ids from
    hosts, so that no level sorts or repeats the rows of the one below.
    """
    keys = ["owner", "rule_title", "record_id", "computer", "channel"]
    host, channel = F.nullif("computer", F.lit("")), F.nullif("channel", F.lit(""))
    none = F.lit("")
    depth = F.when(host.isNull(), 0).when(channel.isNull(), 1).otherwise(2)
    scope = [F.col("record_id").alias("rid"), depth.alias("depth"), F.coalesce(host, none).alias("h"), F.when(depth == 2, channel).otherwise(none).alias("hc")]
    asked = refs.select(*keys).distinct().select(*keys, *scope)
    at = ["rid", "depth", "h", "hc"]
    rows = logs.select(F.col("RecordID").alias("rid"), F.coalesce("Computer", none).alias("c"), F.coalesce("Channel", none).alias("ch"), F.col("RuleTitle").alias("rule_title"))
    rows = stored(rows.join(asked.select("rid").distinct(), "rid", "left_semi").distinct())
    level = lambda df, n, h, hc, *more: df.select("rid", F.lit(n).alias("depth"), h.alias("h"), hc.alias("hc"), *more)
    events = rows.select("rid", "c", "ch").distinct().withColumn("events", F.lit(1).cast("long"))
    hosts = events.groupBy("rid", "c").agg(F.sum("events").alias("events"))
    ids = hosts.groupBy("rid").agg(F.sum("events").alias("events"), F.max("c").alias("c"))
    found = ["events", F.col("c").alias("found")]
    counts = level(events, 2, F.col("c"), F.col("ch"), *found).union(level(hosts, 1, F.col("c"), none, *found)).union(level(ids, 0, none, none, *found))
    by_host = rows.select("rid", "c", "rule_title").distinct()
    by_id = by_host.select("rid", "rule_title").distinct()
    hits = level(rows, 2, F.col("c"), F.col("ch"), "rule_title").union(level(by_host, 1, F.col("c"), none, "rule_title")).union(level(by_id, 0, none, none, "rule_title"))
    per = asked.join(counts, at, "left").join(hits.withColumn("hit", F.lit(True)), [*at, "rule_title"], "left")
    per = per.select(*keys, F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("hit", F.lit(False)).alias("hit"), "found")
    return per.withColumn("state", F.when(F.col("events") == 0, "not_found").when(F.col("events") > 1, F.when(host.isNull(), "ambiguous").otherwise("ambiguous_channels")).when(~F.col("hit") & F.col("rule_title").isNotNull(), "wrong_rule").otherwise("ok"))


#: Excerpts are broadcast up to so many bytes, so that the log's texts are not shuffled to meet them; more meet by shuffle.
BROADCAST_BYTES = 16 << 20


def excerpts(rules: DataFrame, logs: DataFrame, column: str = "Details") -> DataFrame:
    """Whether each rule's excerpt, white space aside, stands in one of its rows."""
    told = rules.where("excerpt is not null").select("rule_title", squeezed(F.col("excerpt")).alias("told")).distinct()
    small = (told.agg(F.sum(F.octet_length("rule_title") + F.octet_length("told") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    rows = logs.select(F.col("RuleTitle").alias("rule_title"), squeezed(F.col(column)).alias("text"))
    met = rows.join(F.broadcast(told) if small else told, "rule_title").groupBy("rule_title").agg(F.max(F.instr("text", F.col("told")) > 0).alias("found"))
    return told.select("rule_title").distinct().join(met, "rule_title", "left").select("rule_title", F.coalesce("found", F.lit(False)).alias("verbatim"))


def recounted(groups: DataFrame, real: DataFrame) -> DataFrame:
    """Declared against recounted variants (rule_title, variant, real): missing, undeclared, count or unjudged; ok rows too.

    A variant that is declared more than once stands for the sum of its counts, and is judged where all of it is.
    """
    told = groups.groupBy("rule_title", F.coalesce("variant", F.lit("")).alias("variant"))
    told = told.agg(F.sum("count").alias("told"), F.when(F.count("verdict") == F.count(F.lit(1)), F.min("verdict")).alias("verdict"))
    real = real.join(told.select("rule_title").distinct(), "rule_title", "left_semi")
    state = F.when(F.col("real").isNull(), "missing").when(F.col("told").isNull(), "undeclared").when(F.col("told") != F.col("real"), "count").when(F.col("verdict").isNull(), "unjudged").otherwise("ok")
    return told.join(real, ["rule_title", "variant"], "full").withColumn("state", state)


def reconcile(groups: DataFrame, logs: DataFrame, keys: list[str]) -> DataFrame:
    """Declared against recounted variants by one list of keys for all rules."""
    return recounted(groups, variants(logs, keys).select(F.col("RuleTitle").alias("rule_title"), "variant", F.col("count").alias("real")))


def consensus(votes: DataFrame) -> DataFrame:
    """Votes per target (with target_type, if there is one) and what they confirm; cannot_verify does not count.

    false_positive is confirmed by a vote for it and none for an attack (mixed counts as attack). attack is
    confirmed by a vote for it and none for false_positive, or by a majority of three counted votes or more.
    Votes that only say indeterminate come to that, others are a conflict; no counted vote gives null.
    """
    keys = [c for c in ("target_type", "target") if c in votes.columns]
    attack, benign, open_ = (F.count_if(F.col("verdict").isin(*v)) for v in (("attack", "mixed"), ("false_positive",), ("indeterminate",)))
    out = votes.groupBy(*keys).agg(attack.alias("attack"), benign.alias("false_positive"), open_.alias("indeterminate"))
    a, f, i = (F.col(c) for c in ("attack", "false_positive", "indeterminate"))
    said = F.when((a == 0) & (f > 0), "false_positive").when((a > 0) & (f == 0), "attack").when((a > 0) & (a + f + i >= 3) & (a > f + i), "attack")
    return out.withColumn("consensus", said.when((a == 0) & (f == 0) & (i > 0), "indeterminate").when(a + f + i > 0, "conflict"))


def parse_refs(entries: DataFrame) -> DataFrame:
    """owner's refs (owner, rule_title, refs, record_ids arrays of id@host@channel) as rows of references, without repeats.

    A bare id in record_ids that refs name already is dropped; parts that are missing are ''; empty ids give no row.
    """
    part = lambda x, n: F.trim(F.coalesce(F.get(F.split(x, "@"), F.lit(n)), F.lit("")))
    as_ref = lambda x: F.struct(part(x, 0).alias("record_id"), part(x, 1).alias("computer"), part(x, 2).alias("channel"))
    none = F.array().cast("array<string>")
    named = F.transform(F.coalesce("refs", none), as_ref)
    ids = F.transform(named, lambda r: r["record_id"])
    rest = F.filter(F.coalesce("record_ids", none), lambda x: x.contains("@") | ~F.array_contains(ids, F.trim(x)))
    every = F.array_union(named, F.transform(rest, as_ref))
    rows = entries.select("owner", "rule_title", F.explode(every).alias("r"))
    return rows.select("owner", "rule_title", "r.*").where("record_id <> ''")


def rederived(clusters: DataFrame, fresh: DataFrame) -> DataFrame:
    """Clusters (id, start, end, verdict, manual) after the levels changed: fresh ones without a verdict, and the manual ones as they were."""
    kept = clusters.where("manual").select("id", "start", "end", "verdict", "manual")
    return fresh.select("id", "start", "end", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("manual")).unionByName(kept)


def progress(rules: DataFrame, clusters: DataFrame, findings: DataFrame, iocs: DataFrame, hosts: DataFrame, levels: list[str]) -> DataFrame:
    """(item, done, total): rules at the levels, judged clusters; findings, indicators and covered hosts as they are."""
    def row(name: str, df: DataFrame, done: Column) -> DataFrame:
        return df.agg(F.count_if(done).alias("done"), F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("item"), "done", "total")

    scope = rules.where(F.arrays_overlap("levels", F.lit(levels)))
    parts = [row("rules", scope, F.col("status") != "pending"), row("clusters", clusters, F.col("verdict").isNotNull())]
    return reduce(DataFrame.union, parts + [row(n, d, F.lit(True)) for n, d in (("findings", findings), ("iocs", iocs), ("hosts", hosts))])


def verdict_summary(rules: DataFrame, levels: list[str]) -> DataFrame:
    """Rules per verdict; pending ones by whether they have an investigated level."""
    scope = F.arrays_overlap("levels", F.lit(levels))
    label = F.when(F.col("status") != "pending", F.col("verdict")).when(scope, "pending").otherwise("pending (out of scope)")
    return rules.groupBy(label.alias("verdict")).agg(F.count(F.lit(1)).alias("rules"), F.sum("count").alias("events"))


def latest_queries(queries: DataFrame) -> DataFrame:
    """The last log entry of each query hash; entries without a hash stand alone."""
    key = F.coalesce("query_hash", F.concat(F.lit("#"), F.col("seq").cast("string")))
    order = Window.partitionBy(key).orderBy(F.desc("seq"))
    return queries.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def latest_hosts(log: DataFrame) -> DataFrame:
    """Last status of each host, with the last note that was given."""
    return log.groupBy("name").agg(F.max_by("status", "seq").alias("status"), F.max_by(F.col("note"), F.when(F.col("note").isNotNull(), F.col("seq"))).alias("note"))


def g0(told: DataFrame, found: DataFrame) -> DataFrame:
    """Fingerprints as recorded and as found; where they are tables of parts, the portions and parts that differ are named."""
    if "part" in told.columns:
        gaps = changed_parts(told, found)
        return gate(gaps, F.concat_ws(" ", "name", F.concat(F.lit("part "), F.col("part").cast("string")), "state"), 0, "integrity")
    return gate(told.join(found, "value", "left_anti"), F.lit("the log has changed"), 0, "integrity")


def g1(rules: DataFrame, levels: list[str]) -> DataFrame:
    return gate(rules.where((F.col("status") == "pending") & F.arrays_overlap("levels", F.lit(levels))), F.col("rule_title"), 1, "rule triage")


def g2(logs: DataFrame, hosts: DataFrame, levels: list[str]) -> DataFrame:
    seen = logs.where(F.lower(F.trim("Level")).isin(*levels) & (F.col("Computer") != "")).select(F.col("Computer").alias("name")).distinct()
    return gate(seen.join(hosts, "name", "left_anti"), F.col("name"), 2, "hosts")


def g3(clusters: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Unjudged clusters; none at all is a gap, too. Rows without a parsed time, by a coverage (ts_total, ts_parsed), are noted."""
    total, parsed = coverage.select("ts_total", "ts_parsed").first() if coverage is not None else (0, 0)
    note = f"warning: {total - parsed} of {total} rows have no parsed time and are in no cluster" if total > parsed else ""
    none = clusters.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no cluster").alias("id"))
    return gate(clusters.where("verdict is null").select("id").union(none), F.col("id"), 3, "clusters", note)


def g4(rules: DataFrame, findings: DataFrame) -> DataFrame:
    return gate(rules.where(F.col("verdict").isin("attack", "mixed")).join(findings, "rule_title", "left_anti"), F.col("rule_title"), 4, "attack rules cited")


def g5(queries: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """Queries whose last entry has more pages and was not accepted so; lines of their log that cannot be read are noted."""
    bad = corrupt.count() if corrupt is not None else 0
    note = f"warning: {bad} lines that cannot be read" if bad else ""
    return gate(latest_queries(queries).where("has_more and not accepted"), F.coalesce("query_hash", F.concat(F.lit("#"), F.col("seq").cast("string"))), 5, "truncation", note)


def g6(refs: DataFrame, rules: DataFrame, logs: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """References that do not resolve to one event hit by the citing rule, and excerpts that are not verbatim; the references of
    indicators (owner, record_id, computer, channel) ask for no rule."""
    if iocs is not None:
        refs = refs.unionByName(iocs.withColumn("rule_title", F.lit(None).cast("string")), allowMissingColumns=True)
    bad = resolve_refs(refs, logs).where("state <> 'ok'").select(F.concat_ws(" ", "owner", "record_id", "state").alias("gap"))
    quoted = excerpts(rules, logs).where("not verbatim").select(F.concat("rule_title", F.lit(" excerpt")).alias("gap"))
    return gate(bad.union(quoted), F.col("gap"), 6, "references")


def g7(rules: DataFrame, refs: DataFrame, findings: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Verdicts and findings without a reference, false positives without an excerpt.

    columns, those of the log: without record ids nothing can be cited, and the gate passes; without a detail column no excerpt is asked for.
    """
    judged = rules.where("status <> 'pending'")
    gaps = judged.join(refs, "rule_title", "left_anti").select(F.concat("rule_title", F.lit(" has no reference")).alias("gap"))
    if columns is None or {"Details", "AllFieldInfo"} & set(columns):
        gaps = gaps.union(judged.where("verdict = 'false_positive' and coalesce(trim(excerpt), '') = ''").select(F.concat("rule_title", F.lit(" has no excerpt"))))
    if findings is not None:
        gaps = gaps.union(findings.join(refs.withColumnRenamed("owner", "id"), "id", "left_anti").select(F.concat("id", F.lit(" has no reference"))))
    if columns is not None and "RecordID" not in columns:
        return gate(gaps.limit(0), F.col("gap"), 7, "evidence cited", "skipped, as the log has no record ids")
    return gate(gaps, F.col("gap"), 7, "evidence cited")


def g8(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Cited rules that are unknown, pending or false positives; indeterminate ones are noted."""
    cited = findings.join(rules, "rule_title", "left")
    state = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "pending", "pending").when(F.col("verdict") == "false_positive", "false_positive")
    open_ = cited.where("verdict = 'indeterminate'").select("id", "rule_title").distinct().count()
    note = f"{open_} cited rules are indeterminate" if open_ else ""
    return gate(cited.withColumn("state", state).where("state is not null"), F.concat_ws(" ", "id", "rule_title", "state"), 8, "compatible rules", note)


def g9(findings: DataFrame, refs: DataFrame, logs: DataFrame) -> DataFrame:
    """Hosts of findings without a row that their references resolve to."""
    good = resolve_refs(refs, logs).where("state = 'ok'").select(F.col("owner").alias("id"), F.col("found").alias("host"))
    return gate(findings.where("trim(host) <> ''").join(good, ["id", "host"], "left_anti"), F.concat_ws(" ", "id", "host"), 9, "finding hosts")


# Fixed value: more variants than this say that the fields are not stable.
MOST_VARIANTS = 2_000
# Columns that say nothing of what happened, and detail keys that do.
NON_CONTENT = ["Computer", "Channel", "EventID", "Level", "RuleTitle", "RecordID", "Timestamp", "Provider", "MitreTactics", "MitreTags", "OtherTags", "RuleFile", "RuleID", "EvtxFile", "RecoveredRecord"]
PROBES = ["Cmdline", "CommandLine", "ParentCommandLine", "Proc", "Image", "NewProcessName", "ParentImage", "Path", "ImagePath", "TgtFile", "TargetFilename", "Svc", "ServiceName", "TaskName", "TgtObj", "TargetObject"]


def g10(rules: DataFrame, groups: DataFrame, logs: DataFrame, keys: list[str] | DataFrame, most: int | None = MOST_VARIANTS) -> DataFrame:
    """Variants: given where they are needed, as counted, not benign without any field, and in line with the rule's verdict.

    keys: the fields that make a variant, one list for all rules or a table (rule_title, fields) with each rule's own.
    Where a rule's fields are all without content, a benign variant may have three values of a probe key at most. A rule with too many
    variants is a gap of its own and is not compared; `most` says how many are too many, and None compares every rule.

    The declared groups, the fields and the counted variants are stored: each is worked out once, and as their sizes are known then,
    small ones are broadcast and the log's rows are not shuffled to meet them.
    """
    groups = stored(groups)
    large = rules.where(F.col("verdict").isin("false_positive", "mixed") & (F.col("count") > VOLUME))
    gaps = large.join(groups, "rule_title", "left_anti").select(F.concat("rule_title", F.lit(" needs variants")).alias("gap"))
    named = groups.select("rule_title").distinct()
    fields = stored(keys) if isinstance(keys, DataFrame) else named.withColumn("fields", F.array(*map(F.lit, keys)).cast("array<string>"))
    keyed = variants_by_rule(logs, fields.join(named, "rule_title", "left_semi")).withColumnRenamed("RuleTitle", "rule_title")
    real = stored(keyed.groupBy("rule_title", "variant").agg(F.count(F.lit(1)).alias("real")))
    over = real.groupBy("rule_title").agg(F.count(F.lit(1)).alias("n")).where(F.lit(False) if most is None else F.col("n") > most).select("rule_title")
    gaps = gaps.union(over.select(F.concat("rule_title", F.lit(" has too many variants"))))
    compared = recounted(groups.join(over, "rule_title", "left_anti"), real).where("state <> 'ok'")
    gaps = gaps.union(compared.select(F.concat_ws(" ", "rule_title", "variant", "state")))
    benign = groups.where(F.col("verdict").isin(*BENIGN)).select("rule_title", "variant")
    gaps = gaps.union(benign.where(~F.coalesce("variant", F.lit("")).rlike(r"[^|\s]")).select(F.concat("rule_title", F.lit(" has an empty benign variant"))))
    attacks = groups.groupBy("rule_title").agg(F.count_if(F.col("verdict") == "attack").alias("attacks"))
    wrong = (F.col("verdict") == "false_positive") & (F.col("attacks") > 0) | (F.col("verdict") == "mixed") & (F.col("attacks") == 0)
    gaps = gaps.union(rules.select("rule_title", "verdict").join(attacks, "rule_title").where(wrong).select(F.concat("rule_title", F.lit(" has other variants than "), "verdict")))
    weak = fields.where(F.forall("fields", lambda f: f.isin(*NON_CONTENT))).select("rule_title")
    probed = keyed.join(benign.join(weak, "rule_title", "left_semi").distinct(), ["rule_title", "variant"], "left_semi")
    seen = diversity(probed, PROBES, by=("rule_title", "variant")).where("diverse").select("rule_title", "variant").distinct()
    gaps = gaps.union(seen.select(F.concat_ws(" ", "rule_title", "variant", F.lit("is too diverse"))))
    return gate(gaps, F.col("gap"), 10, "variants")


def g11(rules: DataFrame, votes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Verdicts over many rows and all findings need votes that confirm them; a mixed rule and a finding need attack confirmed."""
    said = consensus(votes if "target_type" in votes.columns else votes.withColumn("target_type", F.lit("rule")))
    needs = rules.where(F.col("verdict").isin("false_positive", "mixed") & (F.col("count") > VOLUME))
    needs = needs.select(F.lit("rule").alias("target_type"), F.col("rule_title").alias("target"), F.when(F.col("verdict") == "mixed", "attack").otherwise("false_positive").alias("need"))
    if findings is not None:
        needs = needs.union(findings.select(F.lit("finding"), "id", F.lit("attack")).distinct())
    same = F.coalesce(F.col("consensus") == F.col("need"), F.lit(False))
    return gate(needs.join(said, ["target_type", "target"], "left").where(~same), F.concat_ws(" ", "target_type", "target"), 11, "votes")


def run_gates(gates: list[DataFrame]) -> DataFrame:
    """All gates, and a row ALL that passes where they all do. Each gate is worked out once and by itself, as the plan of all would be very large."""
    out = reduce(DataFrame.unionByName, [stored(g) for g in gates])
    whole = out.agg(F.min(F.col("status") == "PASS").alias("ok"), F.sum("n_gaps").alias("n_gaps"))
    status = F.when(F.col("ok"), "PASS").otherwise("FAIL")
    detail = F.concat(F.col("n_gaps").cast("string"), F.lit(" gaps"))
    return out.union(whole.select(F.lit("ALL"), F.lit("all gates"), status, detail, F.array().cast("array<string>"), "n_gaps"))


# Rationales that say nothing.
STUBS = ["reviewed", "checked", "check", "ok", "done", "verified", "confirmed", "fp", "false positive", "benign", "normal", "確認済み", "確認済", "済", "レビュー済み", "レビュー済", "問題なし", "正常"]


def _variant_reasons(groups: DataFrame) -> tuple[DataFrame, list[Column]]:
    """What the declared variants of each rule amount to, and the reasons that follow for an entry joined to it."""
    verdicts = F.coalesce(F.col("verdict").isin("attack", *BENIGN, "indeterminate"), F.lit(False))
    empty = ~F.coalesce("variant", F.lit("")).rlike(r"[^|\s]")
    per = groups.groupBy("rule_title").agg(
        F.count(F.lit(1)).alias("declared"),
        F.countDistinct(F.coalesce(F.trim("variant"), F.lit(""))).alias("keys"),
        F.sum("count").alias("covered"),
        F.min(F.coalesce("count", F.lit(0))).alias("least"),
        F.bool_and(verdicts).alias("judged"),
        F.bool_or(empty & F.coalesce(F.col("verdict").isin(*BENIGN), F.lit(False))).alias("empty"),
        F.count_if(F.col("verdict") == "attack").alias("attacks"),
    )
    benign, mixed = F.col("verdict") == "false_positive", F.col("verdict") == "mixed"
    return per, [
        F.when(F.col("declared").isNull() & (mixed | benign & (F.col("total") > VOLUME)), "missing variants"),
        F.when(F.col("declared") > MOST_VARIANTS, "too many variants"),
        F.when(F.col("keys") < F.col("declared"), "duplicate variants"),
        F.when(F.col("least") <= 0, "bad variant count"),
        F.when(~F.col("judged"), "bad variant verdict"),
        F.when(F.col("empty"), "empty benign variant"),
        F.when(F.col("declared").isNotNull() & (F.coalesce("covered", F.lit(0)) != F.col("total")), "variants do not add up"),
        F.when(benign & (F.col("attacks") > 0) | mixed & (F.col("attacks") == 0), "variants against the verdict"),
    ]


def validate_triage(entries: DataFrame, rules: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """entries (rule_title, verdict, rationale, refs, excerpt) with the reasons to reject each; none means accepted.

    With groups (rule_title, variant, count, verdict), the variants that the entries declare, those are
    checked, too, against the counts of rules; an entry of a rule without groups declares none.
    """
    known = rules.select("rule_title", F.lit(True).alias("known"), *([] if groups is None else [F.col("count").alias("total")]))
    verdicts = ["attack", "false_positive", "mixed", "indeterminate"]
    reasons = [
        F.when(F.col("known").isNull(), "unknown rule"),
        F.when(~F.coalesce(F.col("verdict").isin(*verdicts), F.lit(False)), "bad verdict"),
        F.when((F.length(F.trim(F.coalesce("rationale", F.lit("")))) < 6) | F.lower(F.trim("rationale")).isin(*STUBS), "missing rationale"),
        F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "missing references"),
        F.when(F.col("verdict").isin("false_positive", "mixed") & (F.coalesce(F.trim("excerpt"), F.lit("")) == ""), "missing excerpt"),
    ]
    joined = entries.join(known, "rule_title", "left")
    if groups is not None:
        per, more = _variant_reasons(groups)
        joined, reasons = joined.join(per, "rule_title", "left"), reasons + more
    return joined.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("accepted", F.size("reasons") == 0).select(*entries.columns, "reasons", "accepted")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _missing(*columns: str) -> list[Column]:
    return [F.when(_blank(c), f"missing {c}") for c in columns]


def _outside(c: str, values: list[str]) -> Column:
    """A value outside its enumeration; a blank one is inside."""
    return F.when(~_blank(c) & ~F.trim(F.col(c)).isin(*values), f"bad {c}")


def _judged(entries: DataFrame, reasons: list[Column], warnings: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """entries with the reasons that reject them (none: accepted) and, where a table has them, warnings."""
    out = entries.withColumn("reasons", F.array_compact(F.array(*reasons)))
    more = []
    if warnings is not None:
        out = out.withColumn("warnings", F.array_compact(F.array(*warnings)))
        more = ["warnings"]
    return out.withColumn("accepted", F.size("reasons") == 0).select(*(keep or entries.columns), "reasons", *more, "accepted")


def validate(entries: DataFrame, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Entries of any table with reasons: required fields that are empty, values outside their enumeration."""
    reasons = [F.when(_blank(c), f"missing {c}") for c in required]
    reasons += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), f"bad {c}") for c, v in allowed.items()]
    return entries.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("accepted", F.size("reasons") == 0)


# The enumerations of the accounting tables.
CLUSTER_VERDICTS = ["attack", "benign", "indeterminate"]
HOST_STATUSES = ["investigated", "reviewed", "not_applicable"]
ENV_STATUSES = ["operator_confirmed", "observed", "inferred"]
VOTE_TARGETS = ["rule", "finding"]
VOTE_VERDICTS = ["attack", "false_positive", "mixed", "indeterminate", "cannot_verify"]


def validate_findings(entries: DataFrame, rules: DataFrame, has_record_ids: bool = True) -> DataFrame:
    """entries (title, summary, rule_titles, refs): title and summary, and references where the log has record ids, are needed.

    Rules that are unknown or pending do not reject a finding; they are warnings that name them, in order.
    """
    key = F.sha2(F.to_json(F.struct(*entries.columns)), 256)
    keyed = entries.withColumn("_key", key)
    cited = keyed.select("_key", F.explode("rule_titles").alias("rule_title")).distinct().join(rules.select("rule_title", "status"), "rule_title", "left")
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("rule_title")))), ", ")
    told = cited.groupBy("_key").agg(listed(F.col("status").isNull()).alias("_unknown"), listed(F.col("status") == "pending").alias("_pending"))
    warnings = [F.when(F.col(c) != "", F.concat(F.lit(text), c)) for c, text in (("_unknown", "unknown rules: "), ("_pending", "pending rules: "))]
    refs = [F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "missing refs")] if has_record_ids else []
    return _judged(keyed.join(told, "_key", "left"), _missing("title", "summary") + refs, warnings, entries.columns)


def validate_iocs(entries: DataFrame) -> DataFrame:
    """entries (type, value): both are needed."""
    return _judged(entries, _missing("type", "value"))


def validate_hosts(entries: DataFrame) -> DataFrame:
    """entries (name, status): a name is needed; a status that is not given is the first of the enumeration."""
    out = entries.withColumn("status", F.when(_blank("status"), HOST_STATUSES[0]).otherwise(F.trim("status")))
    return _judged(out, [*_missing("name"), _outside("status", HOST_STATUSES)])


def validate_new_clusters(entries: DataFrame) -> DataFrame:
    """entries (start, end, verdict) of clusters added by hand: dates as YYYY-MM-DD, not reversed; a verdict may wait."""
    dates = {c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_cast(`{c}` AS date)")) for c in ("start", "end")}
    bad = [F.when(d.isNull(), f"bad {c}") for c, d in dates.items()]
    return _judged(entries, [*bad, F.when(dates["end"] < dates["start"], "end before start"), _outside("verdict", CLUSTER_VERDICTS)])


def validate_cluster_verdicts(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """entries (id, verdict) that judge clusters: the cluster has to be known, and a verdict is needed."""
    known = clusters.select("id", F.lit(True).alias("_known")).distinct()
    reasons = [F.when(F.col("_known").isNull(), "unknown cluster"), *_missing("verdict"), _outside("verdict", CLUSTER_VERDICTS)]
    return _judged(entries.join(known, "id", "left"), reasons, keep=entries.columns)


def validate_environment(entries: DataFrame) -> DataFrame:
    """entries (value, status) of facts on the environment: both are needed."""
    return _judged(entries, [*_missing("value", "status"), _outside("status", ENV_STATUSES)])


def validate_votes(entries: DataFrame, rules: DataFrame, findings: DataFrame) -> DataFrame:
    """entries (target_type, target, verdict) of votes: all are needed, and the target has to be a known rule or finding."""
    targets = rules.select(F.lit("rule").alias("_type"), F.col("rule_title").alias("_target")).union(findings.select(F.lit("finding"), "id")).distinct()
    joined = entries.join(targets, (F.trim("target_type") == F.col("_type")) & (F.trim("target") == F.col("_target")), "left")
    sure = ~_blank("target") & F.trim("target_type").isin(*VOTE_TARGETS)
    reasons = [*_missing("target_type", "target", "verdict"), _outside("target_type", VOTE_TARGETS), _outside("verdict", VOTE_VERDICTS)]
    return _judged(joined, [*reasons, F.when(sure & F.col("_target").isNull(), "unknown target")], keep=entries.columns)


def fp_table(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """False-positive rules and benign variants of mixed ones: title, count, basis."""
    whole = rules.where("verdict = 'false_positive'").select("rule_title", "count", F.col("rationale").alias("basis"))
    mixed = groups.where(F.col("verdict").isin(*BENIGN)).join(rules.where("verdict = 'mixed'").select("rule_title"), "rule_title", "left_semi")
    return whole.union(mixed.select("rule_title", "count", F.concat(F.lit("variant "), "variant")))


def indeterminate_list(rules: DataFrame) -> DataFrame:
    return rules.where("verdict = 'indeterminate'").select("rule_title", "count", "rationale")


def coverage_appendix(rules: DataFrame, gates: DataFrame, levels: list[str], most: int = GAPS, logs: DataFrame | None = None) -> DataFrame:
    """(part, name, value) for a report: facts of the log, rules by verdict, gates with their status, and the first gaps of those that fail."""
    verdicts = verdict_summary(rules, levels).select(F.lit("verdict").alias("part"), F.col("verdict").alias("name"), F.col("rules").cast("string").alias("value"))
    status = gates.select(F.lit("gate"), "id", F.concat("status", F.lit(", "), "detail"))
    gaps = gates.where("status = 'FAIL'").select(F.lit("gap"), "id", F.explode(F.slice("gaps", 1, most)))
    out = verdicts.union(status).union(gaps)
    return out if logs is None else out.union(overview(logs).where("metric <> 'path'").select(F.lit("log"), "metric", "value"))


def report_consistency(timeline: DataFrame, text: DataFrame, rules: DataFrame, iocs: DataFrame) -> DataFrame:
    """Problems of a report: false-positive rules on its timeline, and recorded indicators (type, value) that no text of it holds.

    Indicators count from four characters on and have to stand there as they are. All of them are looked for in one pass
    over the texts.
    """
    wrong = timeline.join(rules.where("verdict = 'false_positive'"), "rule_title", "left_semi").select(F.concat(F.lit("false positive on the timeline: "), "rule_title").alias("problem"))
    named = iocs.where("length(value) >= 4").select("type", "value").distinct()
    lost = named.join(occurring(text, "text", named, "value"), "value", "left_anti")
    return wrong.distinct().union(lost.select(F.concat(F.lit("not in the report: "), F.coalesce("type", F.lit("")), F.lit(": "), "value")))
