import base64
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.functions import details as fn
from tidewatch.functions.timestamps import lenient, strict
from tidewatch.operators import details as det
from tidewatch.operators import evidence as ev
from tidewatch.operators import filters as flt
from tidewatch.operators import profile as prof
from tidewatch.operators import sequence as seq
from tidewatch.plans import free_sql, order, ranges
from tidewatch.functions import matching
from tidewatch.sources import logs as src
from tidewatch.sources import state

COLUMNS = "Timestamp string, RuleTitle string, Level string, Computer string, Channel string, EventID string, MitreTactics string, RecordID string, Details string, ExtraFieldInfo string"


def row(ts="2024-01-01 00:00:00.000 +00:00", rule="Alpha", level="high", host="A", channel="Sec", event="1", tactics=None, record="1", details=None, extra=None):
    return (ts, rule, level, host, channel, event, tactics, record, details, extra)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_csv_keeps_backslashes_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Timestamp,Details\n"x","C:\\dir\\"\n"y","a\nb"\n"z",\n')
    rows = [tuple(r) for r in src.load_logs(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [("x", "C:\\dir\\"), ("y", "a\nb"), ("z", None)]


@pytest.mark.parametrize("switch", ["-enc", "-e", "-EncodedCommand", "/enc", "--enc", "–ec", "-encod", "-EC"])
def test_encoded_switches_are_found(spark, switch):
    payload = base64.b64encode("Get-Process".encode("utf-16le")).decode()
    out = det.decode_commands(frame(spark, row(details=f"Cmdline: powershell {switch} {payload}"))).collect()
    assert [r.DecodedCommand for r in out] == ["Get-Process"]


@pytest.mark.parametrize("text", ["-encoding utf8", "---enc QUJDRA==", "-enc ABC", "encQUJDRA==", "-exec QUJDRA==", "-/enc QUJDRA=="])
def test_other_switches_are_not(spark, text):
    assert det.decode_commands(frame(spark, row(details=f"Cmdline: x {text}"))).count() == 0


def test_bad_payload_and_unsafe_characters(spark):
    rlo = base64.b64encode("a‮b".encode("utf-16le")).decode()
    out = det.decode_commands(frame(spark, row(details=f"x -enc {rlo}"), row(details="x -enc QUJDRA"))).collect()
    assert sorted(r.DecodedCommand for r in out)[1] == "a\\u202eb"
    assert "(decode error)" in {r.DecodedCommand for r in out}


def test_pages_rebuild_the_whole(spark):
    logs = frame(spark, *[row(details=f"d{i:03}", record=str(i % 7)) for i in range(100)])
    by = order.total_order(logs)
    parts = [r for o in range(0, 100, 30) for r in order.page(logs, by, 30, o).collect()]
    assert parts == logs.orderBy(*by).collect()
    assert order.paged(logs, by, "x", 10, 500).count() == 1


def by_host(l, host="A", levels=("high",)):
    return l.where((F.col("Computer") == host) & F.col("Level").isin(*levels))


def test_one_query_has_one_identity(spark):
    logs = frame(spark, *[row(host="AB"[i % 2], record=str(i)) for i in range(25)])
    one = order.ask(by_host, logs)
    assert {order.ask(by_host, logs, *a, **k).hash for a, k in ((("A",), {}), ((), {"levels": ["high"]}), ((), {"host": "A"}))} == {one.hash}
    others = [order.ask(by_host, logs, "B"), order.ask(by_host, logs, levels=("high", "low")), order.ask(by_host, logs.select("Computer", "Level")), order.ask(by_host, logs, by=order.search_order)]
    assert len({one.hash, *(o.hash for o in others)}) == 5
    with pytest.raises(ValueError):
        order.ask(lambda l: l, logs)
    pages = [order.paged(one, size=5, offset=o).collect() for o in (0, 5, 10, 15)]
    assert [len(p) for p in pages] == [5, 5, 3, 1] and {r.query_hash for p in pages for r in p} == {one.hash}
    assert [r.RecordID for p in pages[:3] for r in p] == [r.RecordID for r in one.rows.orderBy(*one.order).collect()]
    assert [(p[0].status, p[0].has_more, p[0].next_offset) for p in pages] == [("ok", True, 5), ("ok", True, 10), ("ok", False, None), ("no_data", False, None)]
    assert pages[3][0].RecordID is None and pages[3][0].message
    plain = [order.paged(t, order.total_order(logs), "x", 5).first().query_hash for t in (logs.where("Level = 'high'"), logs.where("Level = 'low'"), logs.where("Level = 'high'"))]
    assert plain[0] == plain[2] != plain[1]


def test_counts_are_kept_by_query_and_version(spark):
    logs = frame(spark, *[row(record=str(i)) for i in range(12)])
    asked, counts = order.ask(by_host, logs), order.Counts(2)
    source = lambda **k: order.paged(asked, size=5, counts=counts, **k).first().count_source
    assert [source(version="1"), source(version="1"), source(version="2"), source(version="1"), source()] == ["count_query", "cache", "count_query", "cache", "count_query"]
    order.paged(order.ask(by_host, logs, "B"), version="1", counts=counts)  # the oldest, of version 2, goes
    assert [source(version="1"), source(version="2")] == ["cache", "count_query"]
    fits, wrong = order.Hint(99, asked.hash, "1"), order.Hint(99, "0" * 64, "1")
    got = [order.paged(asked, size=5, offset=10, version="1", hint=h).first() for h in (fits, wrong)]
    assert [(r.total_count, r.count_source, r.has_more) for r in got] == [(99, "hint", True), (12, "count_query", False)]
    for bad in (order.Hint(-1, asked.hash, "1"), order.Hint(1, "", "1"), order.Hint(1, asked.hash, "")):
        with pytest.raises(ValueError):
            order.paged(asked, hint=bad)
    open_ended = [order.paged(asked, size=6, offset=o, include_total=False).first() for o in (0, 6, 12)]
    assert [(r.total_count, r.has_more, r.status) for r in open_ended] == [(None, True, "ok"), (None, True, "ok"), (None, False, "no_data")]
    page = free_sql.sql_page(logs, "SELECT RecordID FROM logs ORDER BY RecordID", 5, 10, version="1").collect()
    assert [(r.RecordID, r.total_count, r.has_more) for r in page] == [("8", 12, False), ("9", 12, False)]
    assert order.paged(order.ask(by_host, logs, "B")).first().message == "No matching rows"


def test_scans_disclose_what_they_leave_out(spark):
    payload = base64.b64encode("dir".encode("utf-16le")).decode()
    held = [row(ts=f"2024-01-{9 - i:02} 00:00:00.000 +00:00", details=f"powershell -enc {payload}", record=str(i)) for i in range(6)]
    logs = frame(spark, *held, row(details="nothing"), row(details=None))
    for most, status, n in ((4, "partial", 4), (6, "ok", 6), (9, "ok", 6)):
        out = det.decode_first(logs, most).collect()
        assert {(r.status, r.source_event_count) for r in out} == {(status, 6)} and len(out) == n
    assert min(r.Timestamp for r in det.decode_first(logs, 2).collect()) == "2024-01-04 00:00:00.000 +00:00"
    (none,) = det.decode_first(logs.where("Details = 'nothing'")).collect()
    assert (none.status, none.source_event_count, none.DecodedCommand) == ("no_data", 0, None)


def test_flow_techniques_belong_to_their_first_tactic(spark):
    logs = frame(spark, row(tactics="Exec", ts="2024-01-03 00:00:00.000 +00:00"), row(tactics="Evas ¦ Exec", ts="2024-01-02 00:00:00.000 +00:00"), row(tactics="LatMov"))
    tagged = logs.withColumn("MitreTags", F.expr("CASE WHEN MitreTactics = 'Exec' THEN 'T1 ¦ T2' WHEN MitreTactics = 'LatMov' THEN NULL ELSE 'T2' END"))
    assert {r.tactic: (r.next_tactic, r.techniques) for r in seq.tactic_flow(tagged).collect()} == {"LatMov": ("Evas", ""), "Evas": ("Exec", "T2"), "Exec": (None, "T1")}
    assert {tuple(r) for r in seq.flow_edges(tagged).collect()} == {("LatMov", "Evas", "flow"), ("Evas", "Exec", "flow"), ("Evas", "T2", "technique"), ("Exec", "T1", "technique")}
    assert {r.techniques for r in seq.tactic_flow(logs).collect()} == {""}


def test_gates_list_few_of_many_gaps(spark):
    gaps = spark.range(30_000).selectExpr("lpad(cast(id % 20000 as string), 6, '0') as gap").union(spark.sql("SELECT CAST(NULL AS string)"))
    (one,) = ev.gate(gaps, F.col("gap"), 5, "many").collect()
    assert (one.status, one.n_gaps, one.detail, one.gaps) == ("FAIL", 20_000, "20000 gaps", [f"{i:06}" for i in range(10)])
    (none,) = ev.gate(gaps.limit(0), F.col("gap"), 5, "many").collect()
    assert (none.status, none.n_gaps, none.gaps) == ("PASS", 0, [])
    whole = {r.id: (r.status, r.n_gaps) for r in ev.run_gates([ev.gate(gaps, F.col("gap"), k, "x") for k in (1, 2)]).collect()}
    assert whole == {"G1": ("FAIL", 20_000), "G2": ("FAIL", 20_000), "ALL": ("FAIL", 40_000)}


def verdicts(df, key):
    return {r[key]: (r.reasons, r.accepted) for r in df.collect()}


def test_entries_of_each_table_are_judged(spark):
    make = spark.createDataFrame
    rules = make([("A", "done"), ("B", "pending")], "rule_title string, status string")
    findings = make([("t1", "s", ["A"], ["1"]), ("t2", " ", ["B", "C", "B"], []), ("t3", "s", None, None), (None, "s", [], ["1"])], "title string, summary string, rule_titles array<string>, refs array<string>")
    out = ev.validate_findings(findings, rules)
    assert verdicts(out, "title") == {"t1": ([], True), "t2": (["missing summary", "missing refs"], False), "t3": (["missing refs"], False), None: (["missing title"], False)}
    assert {r.title: r.warnings for r in out.collect()} == {"t1": [], "t2": ["unknown rules: C", "pending rules: B"], "t3": [], None: []}
    assert verdicts(ev.validate_findings(findings, rules, has_record_ids=False), "title")["t3"] == ([], True)
    assert ev.validate_findings(findings.union(findings), rules).count() == 8

    assert verdicts(ev.validate_iocs(make([("ip", "1"), ("", "2"), (None, "3"), ("ip", " ")], "type string, value string")), "value") == {"1": ([], True), "2": (["missing type"], False), "3": (["missing type"], False), " ": (["missing value"], False)}

    hosts = ev.validate_hosts(make([("a", None), ("b", "reviewed"), ("c", "odd"), ("", "reviewed")], "name string, status string"))
    assert verdicts(hosts, "name") == {"a": ([], True), "b": ([], True), "c": (["bad status"], False), "": (["missing name"], False)}
    assert {r.name: r.status for r in hosts.collect()}["a"] == "investigated"

    spans = [("2024-01-02", "2024-01-05", "benign"), ("2024-01-02", "2024-01-01", None), ("2024-02-30", "2024-01-05", ""), (None, "soon", "fine"), ("2024-1-2", "2024-01-05", "attack")]
    got = [(r.reasons, r.accepted) for r in ev.validate_new_clusters(make(spans, "start string, end string, verdict string")).collect()]
    assert got == [([], True), (["end before start"], False), (["bad start"], False), (["bad start", "bad end", "bad verdict"], False), (["bad start"], False)]
    judged = make([("c1", "attack"), ("c9", "attack"), ("c1", None), ("c1", "good")], "id string, verdict string")
    got = {(r.id, r.verdict): r.reasons for r in ev.validate_cluster_verdicts(judged, make([("c1",), ("c1",)], "id string")).collect()}
    assert got == {("c1", "attack"): [], ("c9", "attack"): ["unknown cluster"], ("c1", None): ["missing verdict"], ("c1", "good"): ["bad verdict"]}

    assert verdicts(ev.validate_environment(make([("x", "observed"), ("y", "guessed"), ("z", None)], "value string, status string")), "value") == {"x": ([], True), "y": (["bad status"], False), "z": (["missing status"], False)}

    votes = [("rule", "A", "attack"), ("rule", "f1", "attack"), ("finding", " f1 ", "mixed"), ("host", "A", "attack"), ("rule", "", "attack"), ("rule", "B", "sure"), (None, "A", None)]
    got = [r.reasons for r in ev.validate_votes(make(votes, "target_type string, target string, verdict string").coalesce(1), rules, make([("f1",)], "id string")).collect()]
    assert sorted(got) == sorted([[], ["unknown target"], [], ["bad target_type"], ["missing target"], ["bad verdict"], ["missing target_type", "missing verdict"]])


def test_many_strings_are_found_in_one_pass(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab.") for _ in range(rng.randint(1, 7)))
    strings = [*(word() for _ in range(800)), "zé", "a", None, "", "never there"]
    texts = [*("".join(word() for _ in range(6)) for _ in range(60)), None, "", "xzéx"]
    want = {s for s in strings if s and any(s in t for t in texts if t)}
    lines, wanted = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(s,) for s in strings], "value string")
    for size in (1 << 22, 500):
        got = [r.value for r in matching.occurring(lines, "t", wanted, "value", size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert matching.occurring(lines.limit(0), "t", wanted, "value").count() == matching.occurring(lines, "t", wanted.limit(0), "value").count() == 0


def test_report_lacks_indicators_and_shows_false_positives(spark):
    make = spark.createDataFrame
    rules = make([("A", "false_positive"), ("B", "attack"), ("C", "false_positive")], "rule_title string, verdict string")
    iocs = make([("ip", "10.0.0.1"), ("ip", "10.0.0.12"), ("x", "abc"), (None, "lost"), ("ip", "10.0.0.12")], "type string, value string")
    text = make([("seen 10.0.0.1",), (None,)], "text string")
    got = sorted(r.problem for r in ev.report_consistency(make([("A",), ("A",), ("B",)], "rule_title string"), text, rules, iocs).collect())
    assert got == ["false positive on the timeline: A", "not in the report: : lost", "not in the report: ip: 10.0.0.12"]


def test_state_tables_are_read_and_unfolded(spark, tmp_path):
    (tmp_path / "rule_triage.json").write_text(
        """{"version": 1, "rules": [{"rule_title": "A", "levels": {"high": 3}, "count": 3, "status": "done", "evidence": {"refs": [{"record_id": "7", "computer": "H"}], "detail_excerpt": "x"},
        "variants": {"fields": ["Channel", "Svc"], "groups": [{"key": {"Svc": "s", "Channel": "Sec"}, "count": 2, "verdict": "benign"}, {"key": {"Channel": "Sec"}, "count": 1, "verdict": "attack"}]}},
        {"rule_title": "B", "count": 1, "status": "pending"}]}"""
    )
    rules = state.read_state(spark, str(tmp_path), "rules")
    assert {r.rule_title: (r["count"], r.levels) for r in rules.collect()} == {"A": (3, {"high": 3}), "B": (1, None)}
    assert sorted(map(tuple, state.variants_of(rules).collect())) == [("A", "Sec|", 1, "attack"), ("A", "Sec|s", 2, "benign")]
    assert [tuple(r) for r in state.refs_of(rules, "rule_title", "evidence.refs").collect()] == [("A", "7", "H", None)]
    assert all(state.read_state(spark, str(tmp_path), n).count() == 0 for n in state.TABLES if n != "rules")


def test_state_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    table = lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    read = lambda v=None: sorted(r.n for r in state.read_version(spark, path, v).collect())
    assert state.current(spark, path) == 0
    with pytest.raises(ValueError):
        read()
    assert state.write_version(table(1, 2), path, 0) == 1 and read() == [1, 2]
    reader = state.read_version(spark, path)
    broken = table(1, 2, 3).select(F.expr("raise_error('lost')").cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        state.write_version(broken, path, 1)
    assert state.current(spark, path) == 1 and read() == [1, 2]
    assert state.write_version(reader.union(table(3)), path, 1) == 2  # a table may be made of its own last version
    assert read() == [1, 2, 3] and read(1) == [1, 2] and reader.count() == 2
    with pytest.raises(state.Conflict):
        state.write_version(table(9), path, 1)

    def attempt(i):
        try:
            return state.write_version(table(i), path, 2)
        except state.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(attempt, range(10, 14)))
    assert sorted(map(str, done)) == ["3", "None", "None", "None"] and read() == [10 + done.index(3)]
    (tmp_path / "t" / "commits" / "0000000004").write_text("")
    with pytest.raises(state.Conflict):
        read()


def test_one_event_or_its_candidates(spark):
    rows = [row(record="7", host=h, channel=c, rule=r, ts=t, details="K: v") for h, c, r, t in (("A", "Sec", "R2", "t1"), ("A", "Sec", "R1", "t2"), ("B", "Sec", "R1", "t3"), ("B", None, "R1", "t4"))]
    logs = frame(spark, *rows, row(record="8", level="low"))
    got = sorted((r.Computer, r.Channel, r.Timestamp, r.RuleTitles, r.MatchedRows, r.status) for r in det.get_event_detail(logs, "7").collect())
    assert got == [("A", "Sec", "t2", "R1, R2", 2, "ambiguous"), ("B", "", "t4", "R1", 1, "ambiguous"), ("B", "Sec", "t3", "R1", 1, "ambiguous")]
    assert {r.Field: r.Value for r in det.get_event_detail(logs, " 7 ", "A").collect()}["_MatchedRuleTitles"] == "R1, R2"
    assert {r.Field: r.Value for r in det.get_event_detail(logs, "7", "B", "Sec").collect()}["Timestamp"] == "t3"
    assert {r.Field: r.Value for r in det.get_event_detail(logs, sql_filter="Level = 'low'").collect()}["RecordID"] == "8"
    assert [r.status for q in (dict(record_id="9"), dict(sql_filter="Level = 'none'")) for r in det.get_event_detail(logs, **q).collect()] == ["no_data"] * 2
    for bad in (dict(), dict(record_id="7", sql_filter="true"), dict(sql_filter="true", rule="R1"), dict(sql_filter="Level = (SELECT max(Level) FROM elsewhere)"), dict(sql_filter="1; DROP TABLE x")):
        with pytest.raises(ValueError):
            det.get_event_detail(logs, **bad)
    many = frame(spark, *(row(rule=f"R{i}") for i in range(7)))
    assert det.candidates(many).first().RuleTitles == "R0, R1, R2, R3, R4 ..."


def test_parts_of_files_tell_what_changed(spark, tmp_path):
    for name, n in (("a", 500), ("b", 40), ("c", 5)):
        (tmp_path / "old").mkdir(exist_ok=True)
        (tmp_path / "old" / name).write_text("".join(f"line {i}\n" for i in range(n)))
    path = f"file://{tmp_path}/old"
    told = spark.createDataFrame(src.file_parts(spark, path).collect(), src.file_parts(spark, path).schema)
    assert src.changed_parts(told, src.file_parts(spark, path)).count() == 0 and ev.g0(told, src.file_parts(spark, path)).first().status == "PASS"
    assert {(r.algorithm, r["columns"]) for r in told.collect()} == {("sum(xxhash64)x2/64", "value")} and told.agg(F.sum("rows")).first()[0] == 545
    (tmp_path / "old" / "b").unlink()
    (tmp_path / "old" / "d").write_text("x\n")
    (tmp_path / "old" / "a").write_text("".join(f"line {i}\n" if i != 250 else "line 251\n" for i in range(500)))
    found = {(r.name[-1], r.state) for r in src.changed_parts(told, src.file_parts(spark, path)).collect()}
    assert found == {("a", "changed"), ("b", "missing"), ("d", "new")}
    gate = ev.g0(told, src.file_parts(spark, path)).first()
    assert gate.status == "FAIL" and 3 <= gate.n_gaps <= 4 and any("/a part" in g for g in gate.gaps) and any(g.endswith("/b missing") for g in gate.gaps)
    other = src.file_parts(spark, path, 32)
    assert {r.state for r in src.changed_parts(src.file_parts(spark, path), other).collect()} >= {"other digest"}


def test_notes_change_no_gate(spark):
    make = spark.createDataFrame
    clusters = make([("c1", "attack")], "id string, verdict string")
    seen = make([(10, 8)], "ts_total long, ts_parsed long")
    assert ev.g3(clusters, seen).first().detail == "0 gaps; warning: 2 of 10 rows have no parsed time and are in no cluster"
    assert ev.g3(clusters).first().detail == "0 gaps" and ev.g3(clusters, make([(10, 10)], "ts_total long, ts_parsed long")).first().status == "PASS"
    queries = make([], "seq string, query_hash string, has_more boolean, accepted boolean")
    assert ev.g5(queries, make([("{",), ("5",)], "_corrupt_record string")).first().detail == "0 gaps; warning: 2 lines that cannot be read"
    rules = make([("A", "done", "indeterminate"), ("B", "done", "attack")], "rule_title string, status string, verdict string")
    findings = make([("f1", "A"), ("f1", "B"), ("f2", "A")], "id string, rule_title string")
    assert ev.g8(findings, rules).first().detail == "0 gaps; 2 cited rules are indeterminate"


def test_references_of_indicators_and_channels(spark):
    logs = frame(spark, row(record="1", host="A", channel="Sec"), row(record="1", host="A", channel="Sys"), row(record="2", rule="Other"))
    ddl = "owner string, rule_title string, record_id string, computer string, channel string"
    refs = spark.createDataFrame([("f", "Alpha", "1", "A", None), ("f", "Alpha", "1", None, None), ("f", "Alpha", "1", "A", "Sec"), ("g", None, "2", None, None), ("g", "Alpha", "2", None, None)], ddl)
    got = sorted((r.owner, r.rule_title or "", r.record_id, r.computer or "", r.channel or "", r.state) for r in ev.resolve_refs(refs, logs).collect())
    assert [g[-1] for g in got] == ["ambiguous_channels" if g[3:5] == ("A", "") else "ambiguous" if g[2] == "1" and not g[3] else "wrong_rule" if g[:3] == ("g", "Alpha", "2") else "ok" for g in got] and len(got) == 5
    rules = spark.createDataFrame([], "rule_title string, excerpt string")
    iocs = spark.createDataFrame([("ioc 1", "2", None, None), ("ioc 2", "9", None, None)], "owner string, record_id string, computer string, channel string")
    none = refs.limit(0)
    assert ev.g6(none, rules, logs, iocs).first().gaps == ["ioc 2 9 not_found"] and ev.g6(none, rules, logs).first().status == "PASS"


def test_times_as_text(spark):
    from tidewatch.functions.timestamps import as_text

    cases = {"2024-01-01 13:00:00.250 +00:00": "2024-01-01 13:00:00.25+00", "2024-01-01 13:00:00.000 +02:00": "2024-01-01 11:00:00+00", "2024-12-31 23:59:59.123456 +00:00": "2024-12-31 23:59:59.123456+00", "never": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in rows.select("t", as_text(strict(F.col("t"))).alias("x")).collect()} == cases


def test_levels_of_clusters_and_missing_fields(spark):
    logs = frame(spark, row(level=" High ", ts="2024-01-01 00:00:00.000 +00:00"), row(level="low", ts="2024-03-01 00:00:00.000 +00:00"))
    assert [str(r.start) for r in seq.clusters(logs).collect()] == ["2024-01-01"]
    with pytest.raises(ValueError, match="missing columns: Provider"):
        prof.summarize(logs, "Provider")
    assert flt.first_where(frame(spark, row(record="2"), row(record="1")), "Level = 'high'").first().RecordID == "1"


def test_variants_by_each_rule_s_own_fields(spark):
    held = [row(rule="A", host="H1", details=f"Svc: s{i % 2} ¦ Proc: p{i}") for i in range(30)] + [row(rule="B", channel=c, details=f"Proc: p{i}") for i, c in enumerate(["Sec"] * 25 + ["Sys"] * 2)]
    logs = frame(spark, *held, row(rule="C"), *(row(rule="D", record=str(i), details=f"Cmdline: {i}") for i in range(2100)))
    make = spark.createDataFrame
    rules = make([("A", "false_positive", 30), ("B", "mixed", 27), ("C", "false_positive", 1), ("D", "mixed", 2100), ("E", "mixed", 21)], "rule_title string, verdict string, count long")
    fields = make([("A", ["Computer", "Svc"]), ("B", ["Channel"]), ("D", ["Cmdline"])], "rule_title string, fields array<string>")
    groups = make([("A", "H1|s0", 15, "benign"), ("A", "H1|s1", 10, "benign"), ("A", "H1|s1", 5, "benign"), ("B", "Sec", 25, "benign"), ("B", "Sys", 2, "attack"), ("D", "0", 1, "attack")], "rule_title string, variant string, count long, verdict string")
    assert ev.g10(rules, groups, logs, fields).first().gaps == ["B Sec is too diverse", "D has too many variants", "E needs variants"]
    wrong = make([("A", "H1|s0", 14, "benign"), ("A", "H1|", 1, "indeterminate"), ("B", "Sys", 2, None)], "rule_title string, variant string, count long, verdict string")
    got = ev.g10(rules.where("rule_title IN ('A', 'B')"), wrong, logs, fields).first().gaps
    assert got == ["A H1| missing", "A H1|s0 count", "A H1|s1 undeclared", "B Sec undeclared", "B Sys unjudged", "B has other variants than mixed"]


def test_citing_needs_record_ids_and_details(spark):
    rules = spark.createDataFrame([("A", "done", "false_positive", None), ("B", "pending", None, None)], "rule_title string, status string, verdict string, excerpt string")
    refs = spark.createDataFrame([], "owner string, rule_title string, record_id string")
    assert ev.g7(rules, refs).first().gaps == ["A has no excerpt", "A has no reference"]
    assert ev.g7(rules, refs, columns=["RecordID"]).first().gaps == ["A has no reference"]
    one = ev.g7(rules, refs, columns=["Details"]).first()
    assert (one.status, one.n_gaps) == ("PASS", 0) and "skipped" in one.detail


def test_a_dataset_is_made_active_and_dropped(spark):
    logs = frame(spark, row(), row())
    assert src.activate(logs).first().row_count == 2 and spark.table("logs").count() == 2
    assert src.activate(logs.limit(1)).first().row_count == 1 and spark.table("logs").count() == 1
    src.deactivate(spark)
    src.deactivate(spark)
    assert "logs" not in {t.name for t in spark.catalog.listTables()}


def test_the_detail_column_is_named_in_any_case(spark):
    logs = frame(spark, row(details="Proc: x.exe ¦ Cmdline: powershell -enc ZABpAHIA"))
    assert det.extract_iocs(logs, source="details").count() == 2 and det.decode_commands(logs, "DETAILS").first().DecodedCommand == "dir"
    for call in (det.extract_iocs, det.decode_commands):
        with pytest.raises(ValueError, match="try Details"):
            call(logs, source="allfieldinfo")
        with pytest.raises(ValueError, match="use one of"):
            call(logs, source="Other")


def test_null_and_empty_labels(spark):
    logs = frame(spark, row(host=None), row(host=""), row(host=""))
    assert sorted(r["count"] for r in prof.section(logs, "Computer").collect()) == [1, 2]
    merged = prof.profile_all(logs).where("section = 'computers'").collect()
    assert [(r.key, r.value) for r in merged] == [("(empty)", "3")]


def test_last_duplicate_key_wins_and_ioc_quirk(spark):
    out = frame(spark, row(details="K: 1 ¦ K: 2 ¦ none")).select(fn.detail_map(fn.F.col("Details")).alias("m")).first()
    assert out.m == {"K": "2"}
    odd = spark.createDataFrame([("Key  : v",), ("Key : v",)], "p string").select(fn.ioc_value(fn.F.col("p")).alias("v"))
    assert [r.v for r in odd.collect()] == [": v", "v"]


def test_prefix_wildcards_and_folded_patterns(spark):
    logs = frame(spark, row(rule="abc"), row(rule="axc"))
    assert flt.search(logs, "a_c", ["RuleTitle"], mode="prefix").count() == 2
    assert flt.search(logs, r"a\Sc", ["RuleTitle"], mode="regex").count() == 0


def test_two_timestamp_parsers(spark):
    texts = ["2024-01-01 00:00:00.123 +00:00", "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00.1234567 +09:00", "", "x", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(strict(fn.F.col("t")).isNotNull().alias("s"), lenient(fn.F.col("t")).isNotNull().alias("l")).collect()
    assert [(r.s, r.l) for r in out] == [(True, True), (False, True), (False, True), (False, False), (False, False), (False, False)]


def test_bound_is_never_below_the_pairs(spark):
    logs = frame(spark, *[row(ts=f"2024-01-01 00:{i % 60:02}:{i % 7:02}.000 +00:00", host=f"H{i % 4}", record=str(i)) for i in range(200)])
    for minutes in (1, 5, 30):
        assert seq.lateral_pairs(logs, minutes).count() <= seq.lateral_bound(logs, minutes).first()[0]
    both = seq.lateral_pairs(frame(spark, row(host="A"), row(host="B")), 1).collect()
    assert len(both) == 2  # equal times give both directions


def test_guard_counts_the_narrowed_call(spark):
    rows = [row(ts=f"2024-01-01 00:{i % 60:02}:00.000 +00:00", host=f"H{i % 4}", record=str(i)) for i in range(80)]
    logs = frame(spark, *rows)
    assert seq.correlate_lateral(logs, 60, most=500).first().status == "too_broad"
    narrow = seq.correlate_lateral(logs, 60, most=500, source="H1", target="H2")
    assert {(r.SourceHost, r.TargetHost, r.status) for r in narrow.collect()} == {("H1", "H2", "ok")}
    bound = seq.lateral_bound(logs, 60, source="H1", target="H2").first()
    assert narrow.count() <= bound.bound <= 500 and (bound.source_rows, bound.target_rows) == (20, 20)


def test_variants_are_judged_by_content(spark):
    logs = frame(spark, *[row(details=f"Cmdline: c{i}", record=str(i)) for i in range(4)], *[row(rule="Beta", details="Cmdline: c", record=str(i)) for i in range(4)], row(rule="Gamma", channel=None))
    rules = spark.createDataFrame([("Alpha", "false_positive", 4), ("Beta", "mixed", 4), ("Gamma", "false_positive", 1)], "rule_title string, verdict string, count long")
    groups = spark.createDataFrame([("Alpha", "Sec", 4, "false_positive"), ("Beta", "Sec", 4, "false_positive"), ("Gamma", "", 1, "false_positive")], "rule_title string, variant string, count long, verdict string")
    assert ev.g10(rules, groups, logs, ["Channel"]).first().gaps == ["Alpha Sec is too diverse", "Beta has other variants than mixed", "Gamma has an empty benign variant"]


def test_references_are_parsed(spark):
    entries = spark.createDataFrame([("f", "Alpha", ["1@A@Sec", "1@A@Sec", "2"], ["1", "3", "", "1@B"]), ("g", "Alpha", None, None)], "owner string, rule_title string, refs array<string>, record_ids array<string>")
    assert sorted(tuple(r)[2:] for r in ev.parse_refs(entries).collect()) == [("1", "A", "Sec"), ("1", "B", ""), ("2", "", ""), ("3", "", "")]


def test_references(spark):
    logs = frame(spark, row(record="100", host="A"), row(record="100", host="B"), row(record="3", rule="Gamma"), row(record="3", rule="Delta"))
    refs = spark.createDataFrame([("f", "Alpha", "100", None, None), ("f", "Alpha", "100", "A", None), ("f", "Gamma", "3", None, None), ("f", "Alpha", "3", "A", "Sec"), ("f", "Alpha", "9", None, None)], "owner string, rule_title string, record_id string, computer string, channel string")
    assert sorted(r.state for r in ev.resolve_refs(refs, logs).collect()) == ["ambiguous", "not_found", "ok", "ok", "wrong_rule"]


def test_votes(spark):
    votes = spark.createDataFrame([(t, v) for t, vs in {"a": ["attack"], "b": ["attack", "false_positive"], "c": ["attack", "attack", "false_positive"], "d": ["cannot_verify"]}.items() for v in vs], "target string, verdict string")
    assert {r.target: r.consensus for r in ev.consensus(votes).collect()} == {"a": "attack", "b": "conflict", "c": "attack", "d": None}


def test_votes_bind_verdicts(spark):
    votes = {"e": ["false_positive", "false_positive", "attack"], "f": ["false_positive", "indeterminate"], "g": ["attack", "indeterminate"], "h": ["indeterminate"], "i": ["mixed", "attack", "false_positive", "indeterminate"]}
    frame_ = spark.createDataFrame([(t, v) for t, vs in votes.items() for v in vs], "target string, verdict string")
    assert {r.target: r.consensus for r in ev.consensus(frame_).collect()} == {"e": "conflict", "f": "false_positive", "g": "attack", "h": "indeterminate", "i": "conflict"}
    rules = spark.createDataFrame([("e", "false_positive", 30), ("f", "false_positive", 30), ("x", "mixed", 20)], "rule_title string, verdict string, count long")
    findings = spark.createDataFrame([("z", "e", "A")], "id string, rule_title string, host string")
    assert ev.g11(rules, frame_, findings).first().gaps == ["finding z", "rule e"]


def test_references_with_nulls_and_bare_ids(spark):
    logs = frame(spark, row(record="1", host=None, channel=None), row(record="2", host="A", channel=None), row(record="2", host="B", channel=None), row(record="3", host="C"))
    refs = spark.createDataFrame([("f", "Alpha", "1", None, None), ("f", "Alpha", "2", None, None), ("f", "Alpha", "2", "A", ""), ("f", "Alpha", "3", "", "x")], "owner string, rule_title string, record_id string, computer string, channel string")
    assert sorted((r.record_id, r.state, r.found) for r in ev.resolve_refs(refs, logs).collect()) == [("1", "ok", ""), ("2", "ambiguous", "B"), ("2", "ok", "A"), ("3", "ok", "C")]
    findings = spark.createDataFrame([("f", "Alpha", "C"), ("f", "Alpha", "D")], "id string, rule_title string, host string")
    assert ev.g9(findings, refs, logs).first().gaps == ["f D"]
    assert det.event_ambiguity(logs).where("RecordID = '2'").first().ambiguous


def test_stub_rationales_are_rejected(spark):
    entries = spark.createDataFrame([("Alpha", "attack", t, ["1"], None) for t in ("reviewed", "False Positive", "確認済み", "seen twice on A")], "rule_title string, verdict string, rationale string, refs array<string>, excerpt string")
    out = ev.validate_triage(entries, spark.createDataFrame([("Alpha",)], "rule_title string")).collect()
    assert [r.rationale for r in out if r.accepted] == ["seen twice on A"]


def test_variants_of_triage_are_checked(spark):
    entry = "rule_title string, verdict string, rationale string, refs array<string>, excerpt string"
    told = [("A", "false_positive"), ("B", "mixed"), ("C", "mixed"), ("D", "false_positive"), ("E", "false_positive"), ("F", "attack"), ("G", "false_positive")]
    entries = spark.createDataFrame([(t, v, "seen twice on A", ["1"], "x") for t, v in told], entry)
    rules = spark.createDataFrame([("A", 21), ("B", 5), ("C", 5), ("D", 4), ("E", 20), ("F", 99), ("G", 30)], "rule_title string, count long")
    groups = spark.createDataFrame(
        [("B", "x|y", 5, "false_positive"), ("C", "x", 2, "attack"), ("C", "y", 3, "false_positive"), ("D", "|", 2, "false_positive"), ("D", "|", 1, "attack"), ("G", "x", 31, "good"), ("G", None, -1, "indeterminate")],
        "rule_title string, variant string, count long, verdict string",
    )
    got = {r.rule_title: r.reasons for r in ev.validate_triage(entries, rules, groups).collect()}
    assert got == {
        "A": ["missing variants"], "B": ["variants against the verdict"], "C": [], "E": [], "F": [],
        "D": ["duplicate variants", "empty benign variant", "variants do not add up", "variants against the verdict"],
        "G": ["bad variant count", "bad variant verdict"],
    }
    bare = ev.validate_triage(entries.selectExpr("rule_title", "verdict", "rationale", "refs", "' ' AS excerpt"), rules).collect()
    assert {r.rule_title for r in bare if not r.accepted} == {"A", "B", "C", "D", "E", "G"}


def test_indicators_of_both_profiles(spark):
    logs = frame(spark, row(details="Image: a.exe ¦ DstAddr: 1.2.3.4 ¦ TgtFile: C:\\x ¦ Cmdline: a -b ¦ Svc: -"))
    assert {(r.Type, r.FieldName, r.Value) for r in det.extract_iocs(logs).collect()} == {("process", "Image", "a.exe"), ("ip", "DstAddr", "1.2.3.4"), ("filepath", "TgtFile", "C:\\x"), ("cmdline", "Cmdline", "a -b")}
    every = logs.selectExpr("Computer", "RuleTitle", "Level", "'CommandLine: x ¦ SourceIp: 1.1.1.1 ¦ Proc: no' AS AllFieldInfo")
    assert {(r.Type, r.Value) for r in det.extract_iocs(every, source="AllFieldInfo").collect()} == {("cmdline", "x"), ("ip", "1.1.1.1")}
    assert det.extract_iocs(logs, levels=("low",)).count() == 0 and det.extract_iocs(logs, rule="Alp").count() == 4


def test_decoding_does_not_fail(spark):
    odd = base64.b64encode(b"a\0b").decode()
    lone = base64.b64encode(b"\x00\xd8a\0").decode()
    logs = frame(spark, row(details=f"x -enc {odd}"), row(details=f"x -enc {lone}"), row(details="x -enc 'QUJDRA=='"), row(details="y", extra=f"x -enc {odd}"), row(details=None))
    assert sorted(r.DecodedCommand for r in det.decode_commands(logs).collect()) == sorted([base64.b64decode(x).decode("utf-16-le", "replace") for x in (odd, odd, lone)])


def test_backslashes_in_prefixes_and_variants(spark):
    logs = frame(spark, row(rule="C:\\Users\\x"), row(rule="other"))
    assert flt.search(logs, "C:\\Us", ["RuleTitle"], mode="prefix").count() == 1
    split = frame(spark, row(host="a|b", channel="c"), row(host="a", channel="b|c"))
    assert det.variants(split, ["Computer", "Channel"]).count() == 2


def test_fingerprints_tell_logs_apart(spark):
    value = lambda *rows: src.fingerprint(frame(spark, *rows)).first().value
    assert len({value(row(), row()), value(row(host="B"), row(host="B")), value(row(host=None, channel="A")), value(row(host="A", channel=None))}) == 4
    assert value(row(), row(host="B")) == value(row(host="B"), row())


def test_json_lines_and_missing_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"a": "x", "n": 1}\n[1]\n5\n{broken\n\n{"a": null}\n')
    good, bad = src.read_jsonl(spark, str(tmp_path / "q.jsonl"), "a string, n long")
    assert sorted(map(tuple, good.collect()), key=str) == [("x", 1), (None, None)] and sorted(r[0] for r in bad.collect()) == ["5", "[1]", "{broken"]
    assert [x.count() for x in src.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a string")] == [0, 0]
    assert src.file_digests(spark, str(tmp_path)).count() == 1


def test_overview_path_and_tactics(spark):
    logs = frame(spark, row(tactics="Exec ¦ Evas"), row(tactics="Exec"), row(host="B"))
    assert {r.metric: r.value for r in prof.overview(logs, "/it's here").collect()}["path"] == "/it's here"
    assert {r.Computer: r.tactics for r in prof.host_rank(logs).collect()} == {"A": 2, "B": 0}


def test_segments_of_one_list(spark):
    at = lambda d, h="A", t="00:00:00.000": row(ts=f"2024-01-{d:02} {t} +00:00", host=h)

    def found(*rows):
        return [(r.segment, r.start[:16], r.end[:16], r.points) for r in seq.segments(frame(spark, *rows)).orderBy("segment").collect()]

    assert found() == found(row(ts="never")) == []
    assert found(at(8)) == [(1, "2024-01-07 23:00", "2024-01-08 01:00", 1)]
    assert found(at(1), at(1, "B")) == [(1, "2023-12-31 23:59", "2024-01-01 00:01", 2)]
    # Rows of all hosts are one list; two gaps, equal ones: the first is the break.
    assert found(at(1), at(9, "B"), at(5)) == [(1, "2023-12-31 23:57", "2024-01-01 00:03", 1), (2, "2024-01-04 19:12", "2024-01-09 04:48", 2)]
    assert found(at(1), at(2), at(3), at(4, "B")) == [(1, "2023-12-31 22:33", "2024-01-04 01:26", 4)]
    # Equal times are gaps of nothing, which count for the median.
    assert found(at(1), at(1), at(1), at(1), at(2)) == [(1, "2023-12-31 23:59", "2024-01-01 00:01", 4), (2, "2024-01-01 23:57", "2024-01-02 00:03", 1)]


def segments_of(times):
    """The rule again, over a sorted list of microseconds."""
    times, hour = sorted(times), 3_600_000_000
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    middle = (sorted(gaps)[(len(gaps) - 1) // 2] + sorted(gaps)[len(gaps) // 2]) / 2
    cuts = [0, *(i + 1 for i, g in enumerate(gaps) if g > 5 * middle), len(times)]
    parts = [times[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    share = lambda p: (p[-1] - p[0]) / 50 if len(parts) == 1 else (p[-1] - p[0] if len(p) > 1 else hour) / 20
    pads = [max(round(share(p)), 60_000_000) for p in parts]
    return [(i + 1, p[0] - pad, p[-1] + pad, len(p)) for i, (p, pad) in enumerate(zip(parts, pads, strict=True))]


@pytest.fixture
def many_ranges(spark):
    """Small tables keep their several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_segments_over_many_ranges(spark, many_ranges):
    rng = random.Random(4)
    times, now = [], 1_700_000_000_000
    for _ in range(3000):  # milliseconds: bursts, repeats and pauses
        now += rng.choice([0, 0, 1, 5, 40, 40, 60, 150, 900]) if rng.random() < 0.97 else rng.randrange(10**6)
        times.append(now)
    rng.shuffle(times)
    text = lambda ms: (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat(" ", "milliseconds") + " +00:00"
    logs = frame(spark, *(row(ts=text(ms)) for ms in times)).repartition(7)
    micros = lambda t: int((dt.datetime.fromisoformat(t) - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))
    got = [(r.segment, micros(r.start), micros(r.end), r.points) for r in seq.segments(logs).orderBy("segment").collect()]
    assert got == [(i, a // 1000, b // 1000, n) for i, a, b, n in segments_of([1000 * t for t in times])] and len(got) > 20


def test_ranges(spark, many_ranges):
    rows = [(i * 7919 % 1000, i % 13) for i in range(1000)]
    data = spark.createDataFrame(rows, "k long, v long").repartition(5)
    total = {k: sum(v for j, v in rows if j <= k) for k, _ in rows}
    held = ranges.in_ranges(data, F.col("k"))
    assert held.select("_part").distinct().count() > 1
    assert {r.k: r.s for r in ranges.running(held, s=F.col("v")).collect()} == total
    assert {r.k: r.before for r in ranges.previous(held, "k", "before").collect()} == {k: k - 1 if k else None for k, _ in rows}
    assert all(r.n == r.k + 1 for r in ranges.numbered(data, "n", F.col("k")).collect())
    counts = spark.createDataFrame([(5, 3), (1, 2), (9, 1)], "x long, n long")  # 1 1 5 5 5 9
    assert ranges.median(counts, "x", "n") == 5 and ranges.median(counts.where("x <> 9 AND x <> 1"), "x", "n") == 5
    assert ranges.median(counts.where("x <> 5").union(spark.createDataFrame([(9, 1)], "x long, n long").withColumn("x", F.lit(20))), "x", "n") == 5
    assert ranges.median(counts.limit(0), "x", "n") is None and ranges.numbered(data.limit(0), "n", F.col("k")).count() == 0


def test_burst_is_shared_out_among_cells(spark, monkeypatch):
    one = [row(ts=f"2024-01-01 00:{i % 10:02}:{i % 60:02}.000 +00:00", host=f"H{i % 20}", record=str(i)) for i in range(4000)]
    more = [row(ts=f"2024-01-0{2 + i % 3} 0{i % 9}:00:00.000 +00:00", host=f"H{i % 20}", record=str(i)) for i in range(60)]
    logs = frame(spark, *one, *more)
    for side in (100, 2000):
        rows = logs.select(F.substring("Timestamp", 1, 10).alias("day"), "Computer", "RecordID")
        a, b = seq.in_cells(rows.where("Computer = 'H1'"), rows.where("Computer <> 'H1'"), "day", side)
        for part, whole in ((a, 203), (b, 3857)):
            assert part.groupBy("day", "cell").count().agg(F.max("count")).first()[0] < 1.4 * side
            assert part.select("day", "Computer", "RecordID").distinct().count() == whole
        met = a.alias("a").join(b.alias("b"), ["day", "cell"]).groupBy("a.RecordID", "b.RecordID", "day").count()
        want = rows.where("Computer = 'H1'").alias("a").join(rows.where("Computer <> 'H1'").alias("b"), "day").count()
        assert met.count() == want and met.where("count > 1").isEmpty()
    few = frame(spark, *one[:300], *more)
    pairs = sorted(map(tuple, seq.lateral_pairs(few, 5).collect()))
    monkeypatch.setattr(seq.in_cells, "__defaults__", (17,))
    assert sorted(map(tuple, seq.lateral_pairs(few, 5).collect())) == pairs and len(pairs) > 10_000


def test_layers_follow_first_appearance(spark):
    moves = [(3, "Y", "X"), (1, "M", "B"), (2, "B", "A"), (4, "Z", "Y"), (5, "A", "M"), (6, "Q", "B"), (7, "M", "C"), (8, "C", "C")]
    out = seq.layers(spark.createDataFrame(moves, "i int, SourceHost string, TargetHost string"), "i").collect()
    assert {r.host: r.layer for r in out} == {"M": 0, "B": 1, "C": 1, "A": 2, "Y": 3, "X": 4, "Z": 5, "Q": 6}
    assert len(out) == 8 and seq.layers(spark.createDataFrame([], "i int, SourceHost string, TargetHost string"), "i").count() == 0


def test_tactics_by_code_and_source(spark):
    logs = frame(spark, row(tactics="Exec ¦ Evas", ts="2024-01-02 00:00:00.000 +00:00", details="late"), row(tactics="Exec", ts="bad"), row(tactics="LatMov", host="B"))
    got = {r.Phase: r.Details for r in seq.first_per_tactic(logs, ["Exec", "Exe", "Nope", "Exec"], "DETAILS").collect()}
    assert got == {"Execution": "late", "Exe": "late"}
    assert seq.first_per_tactic(logs, []).count() == 0
    with pytest.raises(ValueError):
        seq.first_per_tactic(logs, None, "AllFieldInfo")


def test_event_details(spark):
    logs = frame(spark, row(record="100", host="A"), row(record="100", host="B"), row(record="3", rule="Gamma", details="K: v"), row(record="3", rule="Delta", details="K: v"))
    assert {(r.status, r.Field) for r in det.event_detail(logs, "100").collect()} == {("ambiguous", "A/Sec"), ("ambiguous", "B/Sec")}
    found = {r.Field: r.Value for r in det.event_detail(logs, "3").collect()}
    assert (found["_MatchedRows"], found["_MatchedRuleTitles"], found["Details.K"]) == ("2", "Delta, Gamma", "v")
    assert "_MatchedRows" not in {r.Field for r in det.event_detail(logs, "100", "A").collect()} and det.event_detail(logs, "9").count() == 0


def test_free_sql_reads_logs_alone(spark):
    logs = frame(spark, row())
    spark.range(3).createOrReplaceTempView("secret")
    for text in ("SELECT * FROM logs, secret", "SELECT * FROM logs l, parquet.`/tmp/x` p", "SELECT * FROM logs JOIN (SELECT * FROM secret) s ON true", "SELECT (SELECT max(id) FROM secret) FROM logs", "WITH a AS (SELECT 1) SELECT * FROM a, secret", "SELECT * FROM logs WHERE 1 IN (TABLE secret)", "SELECT * FROM (logs, secret)"):
        with pytest.raises(ValueError):
            free_sql.run_sql(logs, text)
    for text in ("SELECT extract(year FROM now()) AS y FROM logs", "WITH a AS (SELECT Level, count(*) AS n FROM logs GROUP BY Level) SELECT a.n, l.Level FROM a, logs l WHERE a.Level = l.Level", "SELECT Level, 'x, secret' AS t FROM logs -- , secret"):
        assert free_sql.run_sql(logs, text).count() == 1


def test_free_sql_is_guarded(spark):
    logs = frame(spark, row())
    assert free_sql.run_sql(logs, "SELECT count(*) AS n FROM logs").first().n == 1
    for text in ("DROP TABLE logs", "SELECT 1; SELECT 2", "SELECT * FROM range(5)", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM other"):
        with pytest.raises(ValueError):
            free_sql.run_sql(logs, text)


HIDDEN = [
    "SELECT x FROM secret WINDOW w AS (ORDER BY x), secret AS (ORDER BY x)",
    "SELECT x FROM secret WHERE NOT EXISTS (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret WHERE a = 2)",
    "WITH identifier AS (SELECT 1 AS a) SELECT x FROM IDENTIFIER('secret')",
    "SELECT l.Level FROM logs l, IDENTIFIER('default.kept') k",
    "SELECT x FROM kept",
    "SELECT x FROM global_temp.shown",
    "SELECT (SELECT max(x) FROM kept) FROM logs",
    "SELECT count(*) FROM logs WHERE EXISTS (SELECT 1 FROM kept)",
    "SELECT k.x FROM logs, LATERAL (SELECT x FROM kept) k",
    "WITH logs AS (SELECT x FROM kept) SELECT * FROM logs",
    "WITH RECURSIVE t(n) AS (SELECT x FROM kept UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT t.n FROM t, logs",
    "SELECT Level FROM logs) UNION ALL (SELECT CAST(x AS string) FROM kept",
    "SELECT Level FROM logs ORDER BY (SELECT max(x) FROM kept)",
    "SELECT Level FROM logs GROUP BY Level HAVING count(*) > (SELECT min(x) FROM kept)",
]
CALLS = [
    "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM logs",
    "SELECT Level FROM logs WHERE try_reflect('java.lang.System', 'getenv', 'HOME') = ''",
    "SELECT Level FROM logs WHERE Level IN (SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM logs)",
    "SELECT max(reflect('java.lang.System', 'getenv', 'HOME')) FROM logs",
    "SELECT TRANSFORM(Level) USING 'cat' AS (a) FROM logs",
    "SELECT mine(Level) FROM logs",
]
COMMANDS = [
    "INSERT INTO kept SELECT 9",
    "WITH a AS (SELECT 9) INSERT INTO kept SELECT * FROM a",
    "FROM logs INSERT INTO kept SELECT 9",
    "CACHE TABLE logs",
    "SHOW TABLES",
    "SET",
    "EXPLAIN SELECT 1",
    "CREATE TABLE more AS SELECT * FROM logs",
    "SELECT 1; DROP TABLE kept",
]
NOT_LOGS = ["SELECT 1", "WITH logs AS (SELECT 1 AS x) SELECT * FROM logs", "SELECT * FROM VALUES (1)", "SELECT * FROM explode(array(1, 2))", "SELECT * FROM logs, stack(2, 1, 2)", "SELECT * FROM logs, range(3)", "SELECT nope FROM logs", "", " ; "]
SERVED = [
    ("SELECT RecordID, explode(split(Details, ' ¦ ')) AS part FROM logs", 2),
    ("SELECT RecordID, part FROM logs LATERAL VIEW OUTER explode(split(Details, ' ¦ ')) t AS part", 2),
    ("SELECT RecordID, part FROM logs, LATERAL explode(split(Details, ' ¦ ')) AS t(part)", 2),
    ("SELECT Level, Computer, count(*) FROM logs GROUP BY CUBE (Level, Computer)", 4),
    ("SELECT *, row_number() OVER (PARTITION BY Computer ORDER BY RecordID) AS nth FROM logs", 1),
    ("SELECT * FROM (SELECT Level, Computer FROM logs) PIVOT (count(*) FOR Level IN ('high', 'crit'))", 1),
    ("SELECT RecordID FROM logs WHERE Computer IN (SELECT Computer FROM logs)", 1),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT t.n, Level FROM t, logs", 3),
    ("FROM logs |> WHERE RecordID <> '' |> SELECT RecordID", 1),
    ("SELECT Level, Level FROM logs /* secret */ ; ", 1),
    ("TABLE logs", 1),
]


def test_free_sql_by_its_plan(spark):
    logs = frame(spark, row(details="A: b ¦ C: d"))
    spark.range(1).toDF("x").createOrReplaceTempView("secret")
    spark.range(1).toDF("x").createOrReplaceGlobalTempView("shown")
    spark.range(1).toDF("x").write.mode("overwrite").saveAsTable("kept")
    spark.udf.register("mine", lambda x: x)
    for text in HIDDEN + CALLS + COMMANDS + NOT_LOGS:
        with pytest.raises(ValueError):
            free_sql.run_sql(logs, text)
    assert spark.table("kept").count() == 1 and not spark.catalog.tableExists("more")
    for text, n in SERVED:
        assert free_sql.run_sql(logs, text).count() == n, text
    spark.sql("DROP TABLE kept")


def test_free_sql_leaves_the_session_alone_and_orders_pages(spark):
    spark.range(3).toDF("own").createOrReplaceTempView("logs")
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    logs = frame(spark, *(row(record=str(i)) for i in range(9)))
    page = free_sql.run_sql(logs, "SELECT RecordID FROM logs ORDER BY RecordID DESC", 3, 2)
    assert [r.RecordID for r in page.collect()] == ["6", "5", "4"]
    assert spark.table("logs").columns == ["own"] and spark.conf.get("spark.sql.runSQLOnFiles", "true") == before
    for text in ("SELECT RecordID FROM logs", "SELECT * FROM (SELECT RecordID FROM logs ORDER BY 1) WHERE RecordID > '1'", "SELECT RecordID FROM logs SORT BY RecordID", "SELECT RecordID, ' order by ' FROM logs"):
        with pytest.raises(ValueError):
            free_sql.run_sql(logs, text, 3, 2)
    for size, offset in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            free_sql.run_sql(logs, "TABLE logs", size, offset)


def test_empty_tables(spark):
    logs = frame(spark)
    for out in (prof.analyze_rule_titles(logs), prof.by_window(logs), det.extract_iocs(logs), seq.lateral_pairs(logs), seq.clusters(logs), det.expand_events(logs)):
        assert out.count() == 0


def test_references_meet_counts_not_rows(spark):
    rng = random.Random(5)
    pick = lambda *of: rng.choice(of)
    rows = [row(record=pick("1", "2", "3"), host=pick("A", "B", "", None), channel=pick("Sec", "Sys", None), rule=pick("Alpha", "Beta")) for _ in range(25)]
    told = [("f", pick("Alpha", "Beta", None), pick("1", "2", "3", "9", None), pick("A", "B", "", None), pick("Sec", "Sys", "", None)) for _ in range(150)]
    ddl = "owner string, rule_title string, record_id string, computer string, channel string"

    def expected(owner, rule, record, host, channel):
        held = [(r[3] or "", r[4] or "", r[1]) for r in rows if r[7] == record and (not host or r[3] == host) and (not host or not channel or r[4] == channel)]
        n = len({h[:2] for h in held})
        state = "not_found" if n == 0 else ("ambiguous_channels" if host else "ambiguous") if n > 1 else "wrong_rule" if rule and rule not in {h[2] for h in held} else "ok"
        return owner, rule, record, host, channel, n, state, max((h[0] for h in held), default=None)

    got = ev.resolve_refs(spark.createDataFrame(told, ddl), frame(spark, *rows)).select(*[c.split()[0] for c in ddl.split(", ")], "events", "state", "found")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted({repr(expected(*t)) for t in told})
    # As many references as rows with one record id: pairs of them would be 2.5 thousand millions.
    n, began = 50_000, time.monotonic()
    logs = spark.range(n).selectExpr("'1' as RecordID", "'H' || id as Computer", "'Sec' as Channel", "'Alpha' as RuleTitle")
    refs = spark.range(n).selectExpr("'f' || id as owner", "'Alpha' as rule_title", "'1' as record_id", "cast(null as string) as computer", "cast(null as string) as channel")
    assert [tuple(r) for r in ev.resolve_refs(refs, logs).groupBy("state", "events").count().collect()] == [("ambiguous", n, n)]
    assert time.monotonic() - began < 60


def test_variants_are_worked_out_once(spark):
    logs = frame(spark, *[row(rule=r, record=str(i), details=f"Proc: p{i % 2}") for r in ("Alpha", "Beta") for i in range(30)])
    rules = spark.createDataFrame([("Alpha", "mixed", 30), ("Beta", "mixed", 30)], "rule_title string, verdict string, count long")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ddl = "rule_title string, variant string, count long, verdict string"
    groups = spark.createDataFrame([("Alpha", "Sec", 30, "attack"), ("Beta", "Sec", 29, "attack")], ddl).mapInArrow(counted, ddl)
    assert ev.g10(rules, groups, logs, ["Channel"]).first().gaps == ["Beta Sec count"]
    assert read.value == 2


def test_variants_without_a_limit(spark):
    n = ev.MOST_VARIANTS + 1
    logs = spark.range(n).selectExpr("'Alpha' as RuleTitle", "'H' || id as Computer", "'Sec' as Channel", "'high' as Level", "cast(null as string) as Details")
    rules = spark.createDataFrame([("Alpha", "mixed", n)], "rule_title string, verdict string, count long")
    groups = spark.range(n).selectExpr("'Alpha' as rule_title", "'H' || id as variant", "if(id = 7, 2L, 1L) as count", "'attack' as verdict")
    assert ev.g10(rules, groups, logs, ["Computer"]).first().gaps == ["Alpha has too many variants"]
    assert ev.g10(rules, groups, logs, ["Computer"], most=None).first().gaps == ["Alpha H7 count"]


def test_lateral_pairs_are_counted_without_them(spark, monkeypatch):
    rng = random.Random(8)
    at = lambda s: f"2024-01-01 {s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}.000 +00:00"
    rows = [row(ts=at(rng.choice([0, 300, 1200, rng.randrange(9000)])), level=rng.choice(["high", "crit"]), host=rng.choice(["A", "B", "C", None])) for _ in range(300)]
    rows += [row(ts=at(7), level=None, tactics="LatMov", host="A"), row(ts="no time", host="B")]
    logs, keys = frame(spark, *rows), ["SourceHost", "SourceLevel", "TargetHost", "TargetLevel"]
    for side in (seq.COUNTED_SIDE, 9):  # whole buckets, and buckets cut into cells
        monkeypatch.setattr(seq, "COUNTED_SIDE", side)
        for ends in ({}, {"source": "A", "target": "B"}):
            pairs, counts = seq.lateral_pairs(logs, 5, **ends), seq.lateral_counts(logs, 5, **ends)
            assert sorted(map(repr, map(tuple, counts.collect()))) == sorted(map(repr, map(tuple, pairs.groupBy(*keys).count().collect())))
    for stats in (seq.node_stats, seq.edge_stats):
        assert sorted(map(tuple, stats(counts).collect())) == sorted(map(tuple, stats(pairs).collect()))
    # A burst on two hosts in one second each: 3.6 thousand millions of pairs.
    burst = spark.range(60_000).selectExpr("'A' as Computer", "0 as s").union(spark.range(60_000).selectExpr("'B'", "1"))
    burst = burst.selectExpr("'2024-01-01 00:00:0' || s || '.000 +00:00' as Timestamp", "'R' as RuleTitle", "'high' as Level", "Computer", "'' as MitreTactics")
    assert [tuple(r) for r in seq.node_stats(seq.lateral_counts(burst, 5)).orderBy("host").collect()] == [("A", 60_000**2, 0, 60_000**2, "high", 3), ("B", 0, 60_000**2, 60_000**2, "high", 3)]


def test_pairs_are_served_without_a_limit(spark):
    rows = spark.range(3_200).selectExpr("'H' || id % 2 as Computer", "'R' as RuleTitle", "'high' as Level", "'' as MitreTactics", "'2024-01-01 00:00:00.000 +00:00' as Timestamp")
    out = seq.correlate_lateral(rows, 1, most=None, source="H0", target="H1")
    assert seq.correlate_lateral(rows, 1, most=1_000_000, source="H0", target="H1").first().status == "too_broad"
    assert out.count() == 1_600**2 and out.first().status == "ok"


def test_a_folder_of_files_is_one_dataset(spark, tmp_path):
    for name, text in (("part.csv", "abc"), ("docs.csv/part-0.csv", "a" * 1048576), ("docs.csv/part-1.csv", "a" * 1048576), ("deep/partly.csv", "x"), ("part.txt", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    listed = lambda **kw: [(r.alias, r.name, r.size_mb, r.path.endswith(r.name)) for r in src.dataset_inventory(spark, str(tmp_path), **kw).collect()]
    assert listed() == [("partly", "partly.csv", 0.0, True), ("docs", "docs.csv", 2.0, True), ("part", "part.csv", 0.0, True)]
    assert [n[1] for n in listed(name_filter="PART")] == ["partly.csv", "part.csv"] and [n[1] for n in listed(recursive=False)] == ["docs.csv", "part.csv"]


def test_first_gaps_where_all_rows_have_one_record_id(spark, tmp_path):
    n = 40_000  # as many references as rows, all of one id: pairs of them would be 1.6 thousand millions
    events = spark.range(n).selectExpr("id * 7000 AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id AS user_id", "'click' AS event_type", "200D AS value",
        "concat('{\"k\": ', id % 100, '}') AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    began = time.monotonic()
    got = sorted(tuple(r) for r in catalog.QUERIES["rpt_04_first_gaps"](spark, str(tmp_path)).collect())
    assert time.monotonic() - began < 60
    hosts = sorted(f"f-Rule click-{k} HOST-{h}" for k in range(4) for h in range(20) if k % 4 == h % 4)
    assert got == [("gap", "G1", "Rule click-3"), ("gap", "G2", "HOST-7"), *[("gap", "G9", h) for h in hosts[:10]]]


def test_references_are_resolved_from_a_log_read_once(spark, tmp_path):
    frame(spark, row(record="1"), row(record="1", rule="Beta"), row(record="2", host="B"), row(record="2", host="C", channel=None)).write.parquet(f"{tmp_path}/log")
    logs = spark.read.parquet(f"{tmp_path}/log")
    told = [("f", "Alpha", "1", None, None), ("f", "Alpha", "2", "B", "Sec"), ("g", "Beta", "2", None, None), ("g", "Beta", "2", "C", None)]
    out = ev.resolve_refs(spark.createDataFrame(told, "owner string, rule_title string, record_id string, computer string, channel string"), logs)
    assert sorted((r.owner, r.record_id, r.computer or "", r.state, r.events, r.found) for r in out.collect()) == [
        ("f", "1", "", "ok", 1, "A"), ("f", "2", "B", "ok", 1, "B"), ("g", "2", "", "ambiguous", 2, "C"), ("g", "2", "C", "wrong_rule", 1, "C")]
    assert not set(out.inputFiles()) & set(logs.inputFiles())


def test_lateral_pairs_are_shared_out_by_their_number(spark, monkeypatch):
    ends = spark.range(2).selectExpr("'H' || id as Computer", "id * 15000 as shift")
    rows = spark.range(320).crossJoin(ends).selectExpr("Computer", "'R' as RuleTitle", "'high' as Level", "'' as MitreTactics", "date_format(timestamp_millis(1704067200000 + id * 1001 + shift), 'yyyy-MM-dd HH:mm:ss.SSS') || ' +00:00' as Timestamp")
    pairs = seq.lateral_pairs(rows, 5)
    want = pairs.groupBy(*pairs.columns).count().collect()
    monkeypatch.setattr(seq, "TASK", 10_000)
    shared = seq.lateral_pairs(rows, 5)
    assert sorted(map(repr, shared.groupBy(*pairs.columns).count().collect())) == sorted(map(repr, want))
    assert shared.rdd.getNumPartitions() > 8  # the session's number of partitions
    minutes = shared.selectExpr("round((unix_micros(timestamp(replace(TargetTime, '+00', ''))) - unix_micros(timestamp(replace(SourceTime, '+00', '')))) / 60000000.0D, 1) as m", "DeltaMinutes as d")
    assert minutes.where("m <> d or d is null").isEmpty() and minutes.where("d > 0").count() > 10_000
