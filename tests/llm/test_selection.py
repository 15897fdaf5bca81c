"""Hard negatives, importance resampling and decontamination against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import crc, decontaminate, hard_negatives, importance
from tidewatch.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
NAN, INF = float("nan"), float("inf")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_decontamination"])
def test_query_equals_its_oracle(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(duck.sql(f"SELECT {', '.join(sorted(found.columns))} FROM ({ORACLE[name]})").fetchall())


# Hard negatives


def mined(rows, anchors, k=5, low=80, high=100):
    """Pairs by full comparison; rows: {id: (label, integers)}."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=False))
    for a in anchors:
        ranked = sorted((-score(a, b), b) for b in rows if b != a)
        for p in [(s, b) for s, b in ranked if rows[b][0] == rows[a][0]][:k]:
            fit = [(s, b) for s, b in ranked if rows[b][0] != rows[a][0] and low * -p[0] <= 100 * -s <= high * -p[0]][:k]
            out += [(a, p[1], i + 1, b, -p[0], -s) for i, (s, b) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("cell", [1 << 19, 900])
def test_op11_equals_brute_force_over_many_cells_and_buckets(spark, monkeypatch, cell):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = {}
    for i in range(900):  # clusters of very different lengths, copies, and zeros
        v = (centres[rng.integers(6)] + rng.normal(size=12) * 0.2) * rng.choice([0.1, 1, 4])
        rows[i] = (int(rng.integers(4)), (rows[7][1] if 200 < i < 300 else [int(x) for x in np.floor(16 * v)]) if i % 50 else [0] * 12)
    frame = spark.createDataFrame([(i, a, [x / 256 for x in v]) for i, (a, v) in rows.items()], "vec_id long, label int, embedding array<double>")
    found = hard_negatives.mine(frame, F.col("vec_id") % 9 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, [i for i in rows if i % 9 == 0])


def test_op11_prunes_without_losing(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1000, 16)) * 0.05
    v[np.arange(1000), np.arange(1000) % 16] += 1  # rows near the axes
    import pyarrow as pa

    rows = hard_negatives._Rows(pa.table({"id": np.arange(1000), "label": np.zeros(1000, np.int32), "vector": pa.array(list(v))}), "vector", 256)
    (bucket,) = hard_negatives._buckets(rows, np.arange(1000), True)[:1]
    i = int(bucket.ids[0])
    unit = rows.unit(i)
    least = 0.9 * rows.lengths[i] ** 2
    found = bucket.candidates(rows.lengths[i], unit, np.argsort(-np.abs(unit))[:4], least)
    fit = np.flatnonzero(bucket.vectors @ rows.vectors[i] >= least)
    assert set(fit) <= set(found) and len(found) < len(bucket.ids) / 4
    assert bucket.candidates(rows.lengths[i], unit, [0], rows.lengths[i] * bucket.longest * 1.1) is None


def test_op11_odd_and_empty(spark):
    ddl = "vec_id long, embedding array<float>, label int, rank string, score int"
    rows = [(0, [1.0, 0.0], 1), (100, [1.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2), (3, [1.0, NAN], 2), (4, [INF, 0.0], 2), (5, [1.0, None], 2), (6, None, 2), (8, [], 2), (9, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (10, [0.9, 0.0], 3), (200, [1.0, 1.0], 9)]
    frame = spark.createDataFrame([(i, v, a, "clash", 1) for i, v, a in rows], ddl)
    found = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0)
    got = sorted(map(tuple, found.collect()))
    clean = {0: (1, [256, 0]), 100: (1, [256, 0]), 1: (1, [256, 128]), 2: (2, [230, 0]), 8: (2, [0, 0]), 10: (3, [230, 0]), 200: (9, [256, 256])}
    assert got == mined(clean, [0, 100, 200]) and got
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    long = [(0, [1.1e7, 1.0], 1), (1, [1.1e7, 2.0], 1), (2, [1.0e7, 5.0], 2)]  # beyond what doubles multiply exactly
    (row,) = hard_negatives.mine(spark.createDataFrame(long, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert (row.positive_score, row.negative_score) == (256 * 256 * (11_000_000**2 + 2), 256 * 256 * (11_000_000 * 10_000_000 + 5))


# Importance resampling


def test_crc_of_spans_equals_zlib(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    raw = data.tobytes()
    starts = np.concatenate([[0, 5, 17, 3, 100, 0, 9, 0], rng.integers(0, 90_000, 400)])
    sizes = np.concatenate([[0, 1, 63, 64, 65, 128, 129, 300_000], rng.integers(0, 700, 400)])
    want = [zlib.crc32(raw[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
    assert crc.crc32_spans(data, starts, sizes).tolist() == want
    monkeypatch.setattr(crc, "CHUNK_LEVEL", 2)
    monkeypatch.setattr(crc, "CHUNK", crc.BLOCK << 2)  # most spans are longer than what is worked on at once
    assert crc.crc32_spans(data, starts, sizes).tolist() == want
    assert crc.crc32_spans(data, starts[:0], sizes[:0]).tolist() == []


def resampled(docs, target, most=1, percent=10, least=20, k=10_000):
    def buckets(t):
        w = words(t)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % k for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    found = [(i, *buckets(t)) for i, t in docs]
    s, t = [0] * k, [0] * k
    for counts, all_ in ((s, [f for _, _, f in found]), (t, [buckets(x)[1] for x in target])):
        for b in (b for f in all_ for b in f):
            counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + k) / ((a + 1) * (sum(t) + k)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, n, f in found:
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = rank + 1
    return sorted([(r[0], *r[2:]) for r in rows], key=str)


def test_op12_equals_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs, target = [(r.doc_id, r.text) for r in read("documents").collect()], [r.text for r in read("benchmark").collect()]
    assert sorted(map(tuple, QUERIES["op12_importance_resampling"](spark, SF).collect()), key=str) == resampled(docs, target)
    got = importance.resample(read("documents"), read("benchmark"), most=3, percent=37).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, most=3, percent=37)


def test_op12_odd_and_empty(spark):
    docs = [(1, None), (2, ""), (3, "?! \n"), (4, "A1 b2 é" * 30), (4, "A1 b2 é" * 30), (5, "x" * 70_000 + " y"), (None, "some words of no document " * 9), (6, "same text " * 20), (7, "same text " * 20), (8, "wörter " * 30_000)]
    target = ["some words", None, "", "wörter A1"]
    frame = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in docs], "doc_id long, text string, id string, score int, part string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    select = ["doc_id", "n_features", "weight", "score", "rank"]
    for most in (1, 2):
        got = importance.resample(frame, goal, percent=60, most=most).select(*select)
        assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, most=most, percent=60)
    assert importance.resample(frame.limit(0), goal).count() == 0
    got = importance.resample(frame, goal.limit(0)).select(*select)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, [])


# Decontamination


def hits(text, items, size=10):
    w, hit, named = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(size, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == v[k : k + n]:
                    hit.update(range(a, a + n))
                    named.add(str(i)) if i is not None else None
    return len(w), len(hit), sorted(named)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "ONE-two three, four five six seven eight nine ten!"), (10, "short one"), (10, "short one"), (11, None), (12, "?"), (13, "ab ab"), (None, "nameless words"), (14, "ünï çödé")]
TEXTS = [
    (1, "zero one two three four five six seven eight nine ten eleven twelve thirteen"),
    (2, "one two three four five six seven eight nine"),
    (3, "Short. ONE, short one short\tone"),
    (4, "ab ab ab xab ab"),
    (5, None),
    (6, ""),
    (7, "...\n"),
    (8, "nameless words and ünï çÖdé"),
    (9, "é nameless, words é ünï çödé!"),
    (9, "é nameless, words é ünï çödé!"),
    (None, "short one"),
    (10, "filler " * 30_000 + "short one " + "filler " * 1000),
]


@pytest.mark.parametrize("automaton_bytes", [1 << 22, 60])
def test_op13_equals_brute_force_with_one_automaton_or_many(spark, automaton_bytes):
    docs = spark.createDataFrame([(i, t, "gone", 1) for i, t in TEXTS], "doc_id long, text string, found string, n_hit int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, window string")
    rows = decontaminate.contaminated(docs, items, automaton_bytes=automaton_bytes).collect()
    got = sorted(((r.doc_id, r.found.n_words, r.found.n_hit, r.found["items"]) for r in rows), key=str)
    assert got == sorted(((i, *hits(t, ITEMS)) for i, t in TEXTS), key=str)
    for r in rows:
        assert sum(len(words(r.text[s.start : s.start + s.length])) for s in r.found.spans) == r.found.n_hit
    one = next(r for r in rows if r.doc_id == 9)
    assert [one.text[s.start : s.start + s.length] for s in one.found.spans] == ["nameless, words", "ünï çödé"] and one.n_hit == 1


def test_op13_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    clean = decontaminate.contaminated(docs, items.limit(0), keep=["doc_id"]).select("found.*").collect()
    assert len(clean) == len(TEXTS) and all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in clean)
