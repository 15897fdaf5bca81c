"""Fingerprints, media and losses worked out apart, the ways taken beyond size bounds, and odd rows."""

import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import fingerprint, language_model, media, mixing, near_dup, packing, substring_dedup, suffix
from tidewatch.llm.common import stored, unpacked
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    hashes = {chained(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({chained(w)} if w else set())
    low = {h for h in hashes if h < -(1 << 63) + (1 << 61)}
    return low or set(sorted(hashes)[:1])


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints(texts):
    """texts: (id, text) in descending order of ids."""
    out = []
    for k, (i, t) in enumerate(texts):
        t, other = t or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        a, b, c = sketch(t), sketch(edited), sketch(other)
        told = ["".join(f"{h & (1 << 64) - 1:016X}" for h in sorted(s)) for s in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *told, round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out)


def test_op3_fingerprints_equal_those_worked_out_apart(spark, docs):
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in QUERIES["op3_document_fingerprints"](spark, SF).collect()]
    assert sorted(got) == fingerprints(sorted(docs.items(), reverse=True))
    odd = [(1, None), (2, ""), (3, " \n"), (4, "Four words are few"), (5, "ONE two three four five"), (6, "ünï " * 300), (7, "x" * 5000), (8, "one two three four five six")]
    found = fingerprint.digests(spark.createDataFrame([(*r, "clash", 3) for r in odd], "doc_id long, text string, sketch string, n_chars int")).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got) == fingerprints(odd[::-1])


def test_op10_features_worked_out_apart(spark, docs):
    for r in QUERIES["op10_media_columns"](spark, SF).collect():
        raw = docs[r.doc_id].encode()
        x = list(raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw)))
        mean = sum(x) / len(x)
        kinds, *numbers, hist = r.feature.split(";")
        values = dict(n.split("=") for n in numbers)
        assert kinds == f"wav@0+{len(x) + 44}" and hist == "hist=" + ",".join(str(sum(b >> 5 == k for b in x)) for k in range(8))
        assert abs(float(values["mean"]) - mean) < 1e-5 and abs(float(values["std"]) - math.sqrt(sum((b - mean) ** 2 for b in x) / len(x))) < 1e-5
        assert int(values["zc"]) == sum((a ^ b) >> 7 for a, b in zip(x, x[1:], strict=False))
        head = b"RIFF" + (36 + len(x)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + (16000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(x).to_bytes(4, "little")
        assert r.media_bytes == len(x) + 44 and r.media_sha256 == hashlib.sha256(head + bytes(x)).hexdigest()


def test_op10_empty_repeated_and_nameless(spark):
    rows = [(1, "same"), (1, "same"), (None, "same"), (2, None), (3, "long " * 400_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, feature string")
    out = media.media_digests(frame).collect()
    assert len(out) == 5 and len({r.media_sha256 for r in out if r.n_bytes == 4}) == 1 and media.media_digests(frame.limit(0)).count() == 0
    assert {r.payload_bytes for r in out} == {576, 2_000_448}


def test_media_are_carved(spark):
    wav = media.to_wav(b"inner" * 20)
    outer = media.to_wav(b"x" * 40 + wav + b"y" * 7)
    rows = [(1, outer, "png"), (2, b"junk" + wav, None), (3, None, "wav"), (4, b"", "wav"), (4, b"", "wav"), (5, wav, "wav")]
    frame = spark.createDataFrame([(*r, "gone") for r in rows], "id int, data binary, told string, embedded string")
    got = {r.id: r for r in media.sniff_media(frame, "data", "told").collect()}
    assert got[1].true_type == "wav" and got[1].corrected and [bytes(e.bytes) for e in got[1].embedded] == [wav] and got[1].embedded[0].offset == 84
    assert got[2].true_type is None and not got[2].corrected and bytes(got[2].embedded[0].bytes) == wav
    assert got[3].embedded == got[4].embedded == got[5].embedded == [] and not got[5].corrected
    assert [e.bytes for r in media.sniff_media(frame, "data", "told", carve=False).collect() for e in r.embedded] == [None, None]


def test_losses_and_files_beyond_what_is_broadcast(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    usual = sorted(map(tuple, substring_dedup.dedup_digests(frame).collect()))
    written = stored(frame.repartition(5))
    packed = sorted(map(tuple, packing.in_written_order(written).collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(packing, "BROADCAST_FILES", 0)
    assert sorted(map(tuple, substring_dedup.dedup_digests(frame).collect())) == usual
    assert sorted(map(tuple, packing.in_written_order(written).collect())) == packed and len(packed) == frame.count()


def test_op6_long_words_that_all_share_are_no_join_key(spark):
    url = "https://" + "licence/" * 30
    rows = [(i, f"{url} word{i} {'y' * 70}{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words = [t.split() for _, t in rows]
    tokens = [w for ws in words for w in [*ws, ""]]
    count = {w: tokens.count(w) for w in set(tokens)}
    for r in language_model.score(frame, frame).collect():
        want = sum(math.log10((count[w] + 1) / (len(tokens) + len(count) + 1)) for w in [*words[r.doc_id], ""])
        assert abs(r.base_score - want) < 1e-9 and (r.n_tokens, r.n_known) == (4, 4)


def test_op6_and_op7_odd_rows_by_value(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "b"), (4, "one two", "b"), (None, "one", None), (11, "two unknown", "b")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, score int")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in (1, 2, 3, 4, 11)} | {None: False}
    words = {i: (t or "").split() for i, t, _ in rows}
    tokens = [w for i, ws in words.items() if not held[i] for w in [*ws, ""]]
    count = {w: tokens.count(w) for w in set(tokens)}
    train = frame.where("doc_id IS NULL OR crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2")
    out = {r.doc_id: r for r in language_model.score(frame, train).collect()}
    for i, ws in words.items():
        want = sum(math.log10((count.get(w, 0) + 1) / (len(tokens) + len(count) + 1)) for w in [*ws, ""])
        assert abs(out[i].base_score - want) < 1e-9 and (out[i].n_tokens, out[i].train_tokens) == (len(ws) + 1, len(tokens))
    assert out[3].score == out[4].score < out[1].score == out[2].score < 0
    mixed = mixing.mix(frame, {"a": 3, "b": 1}, 1).collect()
    assert sorted(str(r.doc_id) for r in mixed) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "Ünï " * 400), (None, "no id here at all"), (7, "  &<b>"), (8, "word " * 5000)]])
def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", f"s{len(t or '') % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {i for i, _ in rows} and bool(out) == bool(rows)
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    for s in {p[0] for p in places}:
        at = 0
        for _, offset, length in (p for p in places if p[0] == s):
            assert offset == at
            at += length
        assert 0 < at <= 1024
    if rows:
        kept = next(f for n, f in corpus_pipeline.STAGES if n == "near_duplicates")(spark, docs, str(tmp_path))
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, 7, 8]))


def test_slices_of_bitmaps_take_no_byte_for_each_bit(monkeypatch):
    grouped = []

    class Frame:
        select = mapInArrow = groupBy = lambda self, *_: self
        applyInPandas = lambda self, f, _: grouped.append(f)

    monkeypatch.setattr(substring_dedup, "bitmap", lambda *_: None)
    substring_dedup.shared_anchors(Frame(), 0)
    near_dup.census(Frame(), 0)
    hashes = np.repeat(np.random.default_rng(5).integers(0, 2**32, 5_000, np.uint32), near_dup.FEW + 1)
    alone = np.setdiff1d(np.random.default_rng(6).integers(0, 2**32, 5_000, np.uint32), hashes)
    for count, name, bits in zip(grouped, ("anchors", "hashes"), (substring_dedup.BITS, near_dup.BITS), strict=True):
        got = pd.DataFrame({"share": [0, 0], name: [hashes.tobytes(), alone.tobytes()]})
        tracemalloc.start()
        marks = count((0,), got)["marks"][0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < (1 << bits) / 8 * 2
        assert np.flatnonzero(np.unpackbits(unpacked([marks], bits))).tolist() == np.unique(hashes >> np.uint32(32 - bits)).tolist()
        assert unpacked([marks], bits).nbytes == (1 << bits) // 8


def test_op9_compares_only_strings_whose_anchor_has_others(monkeypatch):
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    core = noise(54)
    bodies = [noise(70), b"ab" * 60, b"x" + core, core + b"yz", noise(20) + core[:50]]
    rows = [(i, 10 - i, b, a) for i, (b, a) in enumerate(zip(bodies, (1, 2, 3, 3, 3), strict=True))]
    got = pd.DataFrame([*rows, (0, 4, bodies[0], 1)], columns=["string", "doc_id", "body", "anchor"])
    sizes = []
    array = substring_dedup.suffix_array
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda t: sizes.append(len(t)) or array(t))
    told = substring_dedup._firsts(got)
    assert sizes == [sum(len(b) + 1 for b in bodies[2:]) + 1]
    least = {}
    for _, d, b, _ in got.itertuples(index=False):
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    seen = {(s, i): d for s, first, last, d in told.itertuples(index=False) for i in range(first, last - 49)}
    assert seen == {(s, i): least[b[i : i + 50]] for s, b in enumerate(bodies) for i in range(len(b) - 49)}


def test_same_starts_equal_those_worked_out_apart():
    rng = np.random.default_rng(12)
    for depth in (8, 9, 16, 21, 50):
        strings = [rng.integers(254, 256, rng.integers(depth, depth + 30)).astype(np.uint8) for _ in range(6)]
        strings += [np.append(s[:depth], 0) for s in strings[:3]]
        t = np.concatenate([*[np.append(s.astype(np.uint16) + 2, 1) for s in strings], [0]]).astype(np.uint16)
        sa = suffix.suffix_array(t)
        sa = sa[[1 not in t[i : i + depth] and i + depth < len(t) for i in sa.tolist()]]
        starts = [t[i : i + depth].tolist() for i in sa.tolist()]
        assert suffix.same_starts(t, sa, depth).tolist() == [a == b for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_op9_broadcasts_losses_only_where_they_are_few(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "some text"), (1, None)], "doc_id long, text string")
    for spans, few in ((10, True), (1_100_000, False)):  # 35 MB in all, whatever the size of the files
        lost = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), (F.col("id") > 0).alias("copied"), F.array_repeat(F.array("id", F.col("id") + 1), spans).alias("spans"))
        monkeypatch.setattr(substring_dedup, "losses", lambda _, lost=lost: lost)
        out = substring_dedup.with_losses(docs)
        assert ("Broadcast" in out._jdf.queryExecution().executedPlan().toString()) == few
        assert sorted(out.select("doc_id", "copied", F.coalesce(F.size("spans"), F.lit(0))).collect()) == [(0, None, spans), (1, None, 0)]
