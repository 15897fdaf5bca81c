"""The operators against brute force on small tables, and on odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import fingerprint, html_text, language_model, media, mixing, near_dup, packing, quality, substring_dedup, suffix, url_filter
from tidewatch.llm.common import stored
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
ODD = [(1, None, "en"), (2, "", "en"), (3, "  \n", None), (4, "one two", "x"), (5, "one two", "x"), (5, "one two", "x"), (6, "Ünï " * 400, "src0"), (None, "no id here at all", "x"), (7, "  &<b>", "src0"), (8, "word " * 5000, "src0")]


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, 7, "clash") for i, t, s in ODD], "doc_id long, text string, source string, score int, set string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op1_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()}
    assert got == components(docs)


def test_op1_finds_links_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    texts, k = {}, 0
    for n in (6, 9, 20, 47, 49, 60, 72, 73, 90, 150, 400):
        base = [f"w{rng.integers(1e9)}" for _ in range(n + 4)]
        for cut in (0, 1, n // 9, n // 6, n // 5, n // 4):
            changed = base[: n + 4 - cut] + [f"v{rng.integers(1e9)}" for _ in range(rng.integers(0, cut + 1))]
            texts[k] = " ".join(changed)
            k += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.jaccard_join(frame)[0].collect()}
    assert got == components(texts)


def test_op1_counts_all_links_and_unites_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)  # many pairs of blocks
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(60)]
    texts = {}
    for k in range(150):  # near copies in three families, exact copies, and texts that only share a passage
        base = [f"f{k % 3}x{i}" for i in range(90)]
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(90)] = f"y{rng.integers(1e9)}"
        texts[k] = " ".join(base if k % 10 else [*common, *(f"z{k // 20}q{i}" for i in range(40))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, links = near_dup.jaccard_join(frame, counted_links=True)
    sets = {d: shingles(t) for d, t in texts.items()}
    want = {a: sum(a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    rows = found.collect()
    assert {r.doc_id: r.n_links for r in rows} == want and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts)
    names = {r.set: sets[r.doc_id] for r in rows}
    assert all(100 * len(names[r.a] & names[r.b]) >= 80 * len(names[r.a] | names[r.b]) for r in links.collect())


def test_op1_further_gives_fewer_links_than_members(spark):
    texts = {k: " ".join(f"w{i}" if i != k else "changed" for i in range(400)) for k in range(120)}
    sets = near_dup.shingle_sets(list(texts.values()))
    frame = spark.createDataFrame([(k, len(s), near_dup._sketch(s), s.tobytes()) for k, s in enumerate(sets)], "set long, n long, sketch binary, hashes binary")
    held = spark.createDataFrame([(1, k, k) for k in range(120)], "bucket long, set long, component long")
    assert near_dup.further(held, frame).count() == 119


def test_op1_further_in_a_bucket_of_many_sizes(spark):
    # More members than are compared at once, the last of which are too large for the first.
    small = {k: " ".join(f"s{k // 2}x{i}" if i or k % 2 else "changed" for i in range(40)) for k in range(300)}
    large = {k: " ".join(f"l{k // 2}x{i}" if i or k % 2 else "changed" for i in range(400)) for k in range(300, 340)}
    sets = near_dup.shingle_sets([*small.values(), *large.values()])
    frame = spark.createDataFrame([(k, len(s), near_dup._sketch(s), s.tobytes()) for k, s in enumerate(sets)], "set long, n long, sketch binary, hashes binary")
    held = spark.createDataFrame([(1, k, k) for k in range(340)], "bucket long, set long, component long")
    assert sorted(tuple(sorted(r)) for r in near_dup.further(held, frame).collect()) == [(k, k + 1) for k in range(0, 340, 2)]


def test_op1_odd_and_empty(odd, none):
    got = sorted((r.doc_id, r.component_id) for r in near_dup.jaccard_join(odd)[0].collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    links = sorted((r.doc_id, r.n_links) for r in near_dup.jaccard_join(odd, counted_links=True)[0].collect())
    assert links == [(1, 0), (2, 0), (3, 0), (4, 2), (5, 2), (5, 2), (6, 0), (7, 0), (8, 0)]
    assert near_dup.jaccard_join(none, counted_links=True)[0].count() == 0


def test_op2_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in out.doc_id)


def test_op2_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, None)], "doc_id long, quality int")
    out = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_op3_equals_brute_force(spark, docs):
    rows = sorted(docs.items(), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op3_document_fingerprints"](spark, SF).collect()}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        if len(a | b) > 800:
            assert abs(got[d].near_edited - len(a & b) / len(a | b)) < 0.2
    by_text = {}
    for d, t in docs.items():
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_op3_order_odd_and_empty(spark, odd, none):
    ids = [5, 900, 901, 40_000, 7, 1_000_000, 8]
    frame = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(frame, "text", block=2).collect()}
    down = sorted(ids, reverse=True)
    assert got == {d: f"text {down[(k + 1) % len(down)]}" for k, d in enumerate(down)}
    assert fingerprint.digests(odd).count() == len(ODD) and fingerprint.digests(none).count() == 0


def test_op3_blocks_follow_the_ids(spark):
    ids = [*range(20_000), 10**15, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("text", F.col("doc_id").cast("string"))
    down = sorted(ids, reverse=True)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(frame, "text").collect()}
    assert got == {d: str(down[(k + 1) % len(down)]) for k, d in enumerate(down)}
    assert frame.groupBy(fingerprint._blocks(frame, ("text",), 64)).count().agg(F.max("count")).first()[0] <= 300
    unnamed = frame.select(F.lit(None).cast("long").alias("doc_id"), "text")
    after = [(r.text, r.next_text) for r in fingerprint.with_next(unnamed, "text").collect()]
    assert sorted(t for t, _ in after) == sorted(n for _, n in after) == sorted(map(str, ids))


def test_op4_rules(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/p?q", "http://www.example.com/en/", "http://b.net/es/1#x", "http://b.net/espa", "http://xcom/a", "http://com", "nothing", None, "http://c.com:80/", "http://notexample.com/en/"]
    out = url_filter.filter_urls(spark.createDataFrame([(u, "old") for u in urls], "url string, rule string"), url_filter.rules_frame(spark, url_filter.RULES))
    got = {r.url: (r.rule, r.verdict) for r in out.collect()}
    assert got["http://a.com/x"] == ("com/", "allow") and got["https://EXAMPLE.com/en/p?q"] == ("example.com/en/", "block")
    assert got["http://www.example.com/en/"] == ("www.example.com/en/", "allow") and got["http://b.net/es/1#x"] == ("net/es/", "block")
    assert got["http://notexample.com/en/"] == ("com/", "allow")
    assert all(got[u] == (None, "allow") for u in ("http://b.net/espa", "http://xcom/a", "http://com", "nothing", None, "http://c.com:80/"))


def test_op5_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op5_best_fit_packing"](spark, SF).toPandas()
    for d, t in docs.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        rows = got[got.doc_id == d].sort_values("piece")
        assert rows.length.sum() == len(ids) and list(rows.piece) == list(range(len(rows))) and (rows.length[1:] == 1024).all()
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 1024) * 1.02 + 1


def test_op5_ids_are_the_tokenizers_own(spark, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "", None, " " * 150_000 + "x", "it's  İ 中文\x1c\x85\n\n 12٣!?", "same", "same", "<|endoftext|>"]
    rows = [(k % 7, t, "clash") for k, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string"), path).toPandas()
    want = []
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(none, path).count() == 0
    word = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    assert word.fast is None and word(["Two words"])[0] == np.array(word.tokenizer.encode("Two words", add_special_tokens=False).ids, "<u4").tobytes()


def test_op5_best_fit_takes_the_tightest():
    lengths = np.array([700, 600, 320, 400, 24, 1024, 1])
    sequence, offset = packing.best_fit(lengths)
    assert sequence[2] == sequence[0] and sequence[3] == sequence[1] and sequence[4] == sequence[1]
    rng = np.random.default_rng(1).integers(1, 1025, 500)
    slow, loads = [], []
    for i in np.argsort(-rng, kind="stable"):
        fits = [(1024 - x, k) for k, x in enumerate(loads) if x + rng[i] <= 1024]
        if fits:
            loads[min(fits)[1]] += rng[i]
        else:
            loads.append(rng[i])
    del slow
    assert packing.best_fit(rng)[0].max() + 1 == len(loads)


def test_op6_base_and_model(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_lm_scoring"](spark, SF).collect()}
    counted = Counter()
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counted.update([*words(t), None])
    n, v = sum(counted.values()), len(counted)
    for d, t in docs.items():
        w = [*words(t), None]
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(counted[x] > 0 for x in w), n)
        assert got[d].base_score == pytest.approx(sum(math.log10((counted[x] + 1) / (n + v + 1)) for x in w))
        assert got[d].score < 0


def test_op6_probabilities_sum_to_one_and_beat_a_byte(spark):
    frame = spark.createDataFrame([(i, "the cat sat on the mat and the dog sat on the log") for i in range(50)], "doc_id long, text string")
    strings = language_model.counts(frame).where("code is not null").groupBy("code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    filed = language_model.model(strings)
    context = int.from_bytes(b" the ", "big")
    every = np.arange(256) | (context << 8)
    assert np.exp(language_model.code_lengths(every, filed)).sum() == pytest.approx(1, abs=1e-3)
    assert language_model.score(frame, frame).first().score > -40


def test_op6_odd_and_empty(odd, none):
    assert language_model.score(odd, odd).count() == len(ODD)
    out = language_model.score(odd, none).where("doc_id = 2").first()
    assert (out.n_tokens, out.n_known, out.train_tokens, out.base_score) == (1, 0, 0, 0.0)


def test_op7_stays_within_a_block():
    for shares in ({"a": 40, "b": 20, "c": 20, **{f"s{i}": 10 for i in range(17)}}, {"a": 3, "b": 5, "c": 9, "d": 1}, {"a": 1}):
        total, had = sum(shares.values()), Counter()
        classes = Counter(shares.values())
        members = {u: sorted(s for s in shares if shares[s] == u) for u in classes}
        laid = sorted((at + k - first, members[u][k], block) for u, block, first, last, at in mixing.layout(classes) for k in range(first, last + 1))
        laid = [(source, block, slot) for slot, source, block in laid]
        assert [slot for *_, slot in laid] == list(range(total))
        for source, block, slot in laid:
            assert block == had[source]
            had[source] += 1
            assert all(abs(had[s] - u * (slot + 1) / total) < 1 for s, u in shares.items())


def test_op7_keeps_rows_and_fills_blocks(spark, odd, none):
    out = QUERIES["op7_source_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == 1000 and not out.duplicated(["source", "block", "place"]).any() and out.groupby("slot").source.nunique().max() == 1
    for _, s in out.groupby("source"):
        assert s.groupby("block").size().sort_index()[:-1].eq(32).all() and s.block.max() + 1 == s.block.nunique()
    assert mixing.mix(odd, {"src0": 3}, 1).count() == len(ODD) and mixing.mix(none, {}, 1).count() == 0
    counts = out.source.value_counts().to_dict()
    shares = {s: mixing.SHARES.get(s, mixing.OTHERS) for s in counts}
    classes, total = Counter(shares.values()), sum(shares.values())
    members = {u: sorted((s for s in shares if shares[s] == u), key=lambda s: hashlib.md5(s.encode()).hexdigest()) for u in classes}
    at = {(members[u][k], block): slot + k - first for u, block, first, last, slot in mixing.layout(classes) for k in range(first, last + 1)}
    for r in out.itertuples():
        assert r.slot == r.block // shares[r.source] * total + at[r.source, r.block % shares[r.source]]
    for source, ids in out.sort_values(["slot", "place"]).groupby("source").doc_id:
        assert list(ids) == sorted(ids, key=lambda i: hashlib.md5(f"{source}/{i}".encode()).hexdigest())


def test_op7_any_number_of_sources(spark):
    frame = spark.range(60_000).selectExpr("id as doc_id", "'s' || id % 30000 as source")
    out = mixing.mix(frame, {"s7": 40}, 10, 2).toPandas()
    assert len(out) == 60_000 and (out.place < 2).all() and out.groupby("slot").source.nunique().max() == 1
    total = 40 + 10 * 29_999
    assert (out.slot < total // 10 + 1).all() and out.groupby("source").slot.nunique().eq(1).all()
    with pytest.raises(ValueError):
        mixing.mix(frame, {"s7": 40}, 0)


def test_op8_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="sidebar">side</div><article><h1>A &amp; B</h1><p><b>One
    two&nbsp;three<br>four<p>Five <i>six</i></p><form><p>sign up</form><div class="comments"><p>reader says</div></article><footer>foot</footer></body></html>"""
    blocks = html_text.blocks_of(page)
    assert html_text.text_at(blocks, html_text.best_path(blocks)[0]) == "A & B\nOne two three four\nFive six"


def test_op8_hosts_agree_and_odd(spark):
    long = "<body><div class='story12'><p>{}</p></div><div class='ad'>x</div></body>"
    rows = [(i, "http://h.net/1", long.format("text " * 30)) for i in range(3)] + [(3, "http://h.net/2", "<body><div class='story7'><p>short</p></div><section><p>longer than that</p></section></body>"), (4, None, None), (5, "x", ""), (5, "x", "")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "short" and got[4].text == "" and got[5].n_chars == 0


def test_op8_keeps_all_of_an_article():
    text = lambda page: html_text.text_at(b := html_text.blocks_of(page), html_text.best_path(b)[0])
    lead, story = "A lead of some words that opens it.", "The story goes on and on. " * 20
    assert text(f"<body><article><h1>T</h1><div class=lead><p>{lead}</p></div><div class=story><p>{story}</p></div></article></body>") == f"T\n{lead}\n{story.strip()}"
    assert text(f"<body><div class=page><div class=lead><p>{lead}</p></div><div class=story><p>{story}</p></div></div><div><a href=x>m</a></div></body>") == f"{lead}\n{story.strip()}"
    kept = "<div class=legal><p>The court held</p></div><section class=search><p>They searched</p></section><p class=foot-note>Note</p><p><label>Named</label> thing</p>"
    assert text(f"<article><p>{story}</p>{kept}<div class=comments><p>reader</p></div><form><label>Mail</label></form></article>") == f"{story.strip()}\nThe court held\nThey searched\nNote\nNamed thing"


def test_op8_own_path_empty_clashing_and_long(spark, none):
    story = "The story goes on. " * 30
    usual = f"<body><div class=a><p>{story}</p></div></body>"
    other = f"<body><div class=a><p>Tiny</p></div><div class=b><p>{story}</p></div></body>"
    long = "<article>" + "<p>" + "word &amp; " * 40_000 + "</p>" * 3 + "</article>"
    rows = [(k, "http://h.net/", usual, "x", 7) for k in range(3)] + [(3, "http://h.net/", other, "x", 7), (4, "http://l.net/", long, "x", 7), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, n_chars long")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[0] == got[3] == story.strip() and got[4] == ("word & " * 40_000).strip() and got[None] == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_op8_whole_table(spark):
    pages = QUERIES["op8_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in pages:
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.text.split("\n")[0] and r.n_chars == len(r.text) and "&copy" not in r.text
        assert r.text.count("\n") == article.count("<p>")


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for _ in range(60):
        strings = [rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        t = np.concatenate([*[np.append(s + 2, 1) for s in strings], [0]]).astype(np.uint16)
        sa, plain = suffix.suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        common = suffix.common_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while plain[a + n] == plain[b + n] and plain[a + n] > 1:
                n += 1
            assert common[b] == n


def removed(texts):
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        own = {raw[i : i + 50] for i in range(len(raw) - 49)}
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
        seen |= own
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_op9_equals_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_suffix_array_dedup"](spark, SF).collect()}
    assert got == removed(docs)


def test_op9_odd_and_empty(spark, odd, none):
    texts = {1: "x" * 49, 2: "x" * 49, 3: "x" * 50, 4: "ab" * 60, 5: "yy" + "ab" * 60 + "é" * 30, 6: "é" * 30, 7: None, 8: "", 9: "x" * 200}
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == removed(texts)
    assert substring_dedup.dedup_digests(odd).count() == len(ODD) and substring_dedup.dedup_digests(none).count() == 0


def test_op9_deals_hot_anchors_by_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2_000)
    monkeypatch.setattr(substring_dedup, "ARRAY", 1_000)
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    noise = lambda n: "".join(rng.choice(letters, n))
    line, passage = noise(30), noise(130)
    texts = {}
    for k in range(300):  # one short line in all documents, each time in other surroundings; a long passage and repeats in some
        texts[k] = noise(60) + line + noise(60) + (passage if k % 7 == 3 else "") + (texts[k - 40][30:100] if k > 60 and k % 5 == 0 else "")
    found, which, _ = substring_dedup.anchors([t.encode() for t in texts.values()])
    held = Counter(a for a, _ in set(zip(found.tolist(), which.tolist(), strict=True)))
    assert max(held.values()) * substring_dedup.MATCH > substring_dedup.HOT
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == removed(texts) and any(r[1] for r in got.values())


def test_op10_round_trip(spark, docs):
    for r in QUERIES["op10_media_columns"](spark, SF).collect():
        raw = docs[r.doc_id].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.true_type == "wav" and r.corrected and r.media_bytes == len(payload) + 44


def test_op10_sniffs_and_carves(spark):
    import struct

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav = media.to_wav(b"a" * 100)
    assert media.sniff(b"xx" + png + b"BM RIFF" + wav) == [("png", 2, len(png)), ("wav", 2 + len(png) + 7, len(wav))]
    assert media.sniff(png[:-1]) == [] and media.sniff(png.replace(b"IDAT", b"IDAU")) == []
    out = media.sniff_media(spark.createDataFrame([(png, "jpeg"), (None, "png"), (b"", None)], "d binary, t string"), "d", "t").collect()
    assert [(r.true_type, r.corrected) for r in out] == [("png", True), (None, False), (None, False)]
    assert media.media_digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("payload_sha256").distinct().count() == 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, "/root/testdata/sf0.01")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and 800 < len(kept) < 1000
    single = stages["near_duplicates"](spark, docs.where("doc_id < 300"), "/root/testdata/sf0.01")
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in components({d: t for d, t in texts.items() if d < 300}).items() if c == d}
    cut = stages["repeated_passages"](spark, docs, "/root/testdata/sf0.01")
    assert cut.columns == columns and cut.count() == 1000
    assert sum(r.n_chars for r in cut.collect()) < sum(map(len, texts.values()))
    mixed = stages["source_mix"](spark, docs, "/root/testdata/sf0.01")
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(texts)
    assert pd.unique(stages["packing"](spark, docs, "").toPandas().doc_id).size == 1000


def test_pipeline_packs_along_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    order = [r.doc_id for r in mixing.mix(docs, mixing.SHARES, mixing.OTHERS, 4).orderBy("slot", "place").collect()]
    at = {d: i for i, d in enumerate(order)}
    written = stored(mixing.in_order(mixing.mix(docs, mixing.SHARES, mixing.OTHERS, 4), 5).select(*docs.columns))
    assert {r.doc_id: r.position for r in packing.in_written_order(written).collect()} == at
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_in_order(written, tokenizer, share=20).toPandas()
    plain = packing.pack(docs, tokenizer).toPandas()
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[piece].itertuples(index=False)) == sorted(plain[piece].itertuples(index=False))
    got["position"] = got.doc_id.map(at)
    assert (got.sequence_id // 2**32 == got.position // 20).all()
    for _, share in got.groupby(got.sequence_id // 2**32):
        want = share.sort_values(["length", "position", "piece"], ascending=[False, True, True])
        sequence, offset = packing.best_fit(want.length.to_numpy())
        assert list(want.offset) == list(offset) and pd.Series(sequence).groupby(want.sequence_id.to_numpy()).nunique().eq(1).all()
        begins = share[share.offset == 0].sort_values("sequence_id")
        assert list(begins.sequence_id % 2**32) == list(range(sequence.max() + 1))
        assert list(zip(begins.position, begins.piece, strict=True)) == sorted(zip(begins.position, begins.piece, strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024


def test_pipeline_order_odd_and_empty(spark, odd, none):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_in_order(odd, tokenizer, share=3).toPandas()
    assert len(got) == len(packing.pack(odd, tokenizer).toPandas()) and sorted(r.position for r in packing.in_written_order(odd).collect()) == list(range(len(ODD)))
    assert packing.pack_in_order(none, tokenizer).count() == 0


def test_pipeline_needs_the_mix(spark, monkeypatch):
    whole = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == whole
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != "source_mix"])
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) != whole


def context_tree(training, queries):
    """Logarithms of chances by a plain context tree, every node of which counts."""
    tree = {}
    for code, n in training.items():
        for k in range(8):
            prefix, bit = (1 << k) | ((code & 255) >> (8 - k)), (code >> (7 - k)) & 1
            for d in range(6):
                tree.setdefault((d, (code >> 8) & ((1 << 8 * d) - 1), prefix), [0, 0])[bit] += n
    below, weight = Counter(), {}
    for node in sorted(tree, reverse=True):
        (d, c, prefix), (a, b) = node, tree[node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        whole = own if d == 5 else np.logaddexp(own, below[node]) - math.log(2)
        weight[node] = 1.0 if d == 5 else math.exp(own - math.log(2) - whole)
        below[d - 1, c & ((1 << 8 * max(0, d - 1)) - 1), prefix] += whole
    out = []
    for code in queries:
        total = 0.0
        for k in range(8):
            p, known = 0.5, False
            for d in range(5, -1, -1):
                node = d, (code >> 8) & ((1 << 8 * d) - 1), (1 << k) | ((code & 255) >> (8 - k))
                if node in tree:
                    own = (tree[node][1] + 0.5) / (sum(tree[node]) + 1)
                    p, known = weight[node] * own + (1 - weight[node]) * p if known else own, True
            total += math.log(p if (code >> (7 - k)) & 1 else 1 - p)
        out.append(total)
    return out


def test_op6_equals_a_plain_context_tree(spark):
    few = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12").select("doc_id", "text")
    train = few.where("doc_id < 8")
    texts = {r.doc_id: language_model.codes([language_model.tokens(r.text)])[0].tolist() for r in few.collect()}
    training = Counter(c for d, t in texts.items() if d < 8 for c in t)
    asked = sorted({c for t in texts.values() for c in t})
    chance = dict(zip(asked, context_tree(training, asked), strict=True))
    strings = language_model.counts(train).where("code is not null").groupBy("code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert np.allclose(language_model.code_lengths(np.array(asked), language_model.model(strings, 7)), list(chance.values()), rtol=0, atol=1e-6)  # kt_log is good to some 1e-9
    for r in language_model.score(few, train).collect():
        assert r.score == pytest.approx(sum(chance[c] for c in texts[r.doc_id]) / math.log(10), rel=1e-6)
