"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a node for every context of 0 to 5 preceding bytes.
A node's counts give a Krichevsky-Trofimov estimate, and context-tree weighting mixes the estimates of all
depths: a node's weight is the posterior, given the training text, that contexts need not be longer there.
Spark counts byte strings and words over the training texts. Every node counts, also those reached once.
Strings whose last two context bytes agree meet in one share, which holds all nodes of two bytes and more
above them; the nodes of less (at most 256 * 255 and 255) are summed over the shares and go to all. The texts
scored are dealt into chunks: each sends its distinct byte strings to the shares and gets their code lengths
back. A word unigram model over the same tokens is the base that scores are compared with.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, release, slices, stored, table, volume

DEPTH = 5
#: Context bytes that decide a string's share; shallower nodes are broadcast.
SPLIT = 2
#: Bytes of training text to a share, and of scored text to a chunk.
SHARE, CHUNK = 24_000_000, 16_000_000
#: The most frequent words, of up to 64 bytes, are broadcast with their counts (at most 10 MB), and so are the most frequent longer
#: ones, by their MD5 (under 2 MB); counts of all other words are joined by shuffle.
HOT_WORDS, HOT_LENGTH, HOT_LONG = 1 << 17, 64, 1 << 14
_SPREAD = 40_503  # odd, so that it only changes the order of the 2^16 numbers
_DOC = 15  # bits for a document's number within a slice, beside the 48 of a byte string


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def _numbers(docs: list[list[bytes]], places: range) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each document with the ones before it as one number, and its document's number.

    places: where the nearest byte before it stands in the number, then the next, and so on. A document is
    its words, one blank between them, and a line end; zeros stand before its start.
    """
    texts = [b" ".join(words) + b"\n" for words in docs]
    b = np.frombuffer(b"".join(bytes(DEPTH) + t for t in texts), np.uint8)
    n = max(0, len(b) - DEPTH)
    out = np.zeros((n, 8), np.uint8)  # the bytes of little-endian numbers
    out[:, 0] = b[DEPTH : DEPTH + n]
    for i, place in enumerate(places, 1):
        out[:, place] = b[DEPTH - i : DEPTH - i + n]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + DEPTH) - DEPTH - sizes  # the first of the zeros before each text
    real = np.ones(n + DEPTH, bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return out.view("<i8").ravel()[real[DEPTH:]], np.repeat(np.arange(len(texts)), sizes)


def codes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with the five before them in the order of the text, and their documents' numbers."""
    return _numbers(docs, range(1, DEPTH + 1))


def keys(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """As codes, but with the context turned round (see _keys)."""
    return _numbers(docs, range(DEPTH, 0, -1))


def _packed(key: np.ndarray) -> bytes:
    """Sorted numbers as differences, which compress well on their way."""
    return np.diff(key, prepend=0).tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.cumsum(np.frombuffer(x, np.int64)) for x in packed)])


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def _batch(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names)


def counts(docs: DataFrame) -> DataFrame:
    """(code, word, n): byte strings and words of the texts with partial counts, and a null word for text ends."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts = 0

        def given() -> Iterator[pa.RecordBatch]:
            if words:
                keys = list(words)
                yield _batch([pa.nulls(len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array(list(words.values()), pa.int64())], ["code", "word", "n"])
                words.clear()
            if parts:
                code, n = _count(parts)
                yield _batch([pa.array(code), pa.nulls(len(code), pa.binary()), pa.array(n)], ["code", "word", "n"])
                parts.clear()

        for batch in slices(batches, "text", 2_000_000):
            split = [tokens(t) for t in batch.column(0).to_pylist()]
            texts += len(split)
            for w in split:
                words.update(w)
            code, n = np.unique(codes(split)[0], return_counts=True)
            parts.append((code, n))
            if len(parts) >= 24:
                parts[:] = [_count(parts)]
            if len(words) > 1_000_000:
                yield from given()
        yield from given()
        if texts:
            yield _batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([texts], pa.int64())], ["code", "word", "n"])

    return docs.select("text").mapInArrow(read, "code long, word binary, n long")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up: good to 1e-10 from 0.5 on."""
    low = x.copy()
    product = np.ones_like(x)
    for _ in range(7):
        product *= low
        low = low + 1
    return (low - 0.5) * np.log(low) - low + 0.5 * np.log(2 * np.pi) + 1 / (12 * low) - 1 / (360 * low**3) + 1 / (1260 * low**5) - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = zeros.astype(float) + 0.5, ones.astype(float) + 0.5
    return _lgamma(a) + _lgamma(b) - np.log(np.pi) - _lgamma(a + b + 0.0)


def _keys(code: np.ndarray) -> np.ndarray:
    """Byte strings with the context turned round, the nearest byte first: shorter contexts are beginnings of longer ones."""
    key = code & 255
    for i in range(1, DEPTH + 1):
        key = key | (((code >> (8 * i)) & 255) << (8 * (DEPTH + 1 - i)))
    return key


def _share(key: np.ndarray, shares: int) -> np.ndarray:
    """The share of a string: by the two bytes nearest to it, spread over 2^16 numbers."""
    return ((key >> (8 * (DEPTH + 1 - SPLIT))) * _SPREAD & 0xFFFF) % shares


def _at(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted nodes among sorted ones, and whether they are there."""
    if not len(nodes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
    return at, nodes[at] == wanted


def _prefix(strings: np.ndarray, k: int) -> np.ndarray:
    """The node of the k-th bit: context, then the bits so far after a leading 1."""
    return (strings >> 8 << 8) | (1 << k) | ((strings & 255) >> (8 - k))


def _shorter(strings: np.ndarray) -> np.ndarray:
    """The same with a context one byte shorter."""
    return (strings >> 16 << 8) | (strings & 255)


def _by_depth(key: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct strings and their counts from the greatest depth down to SPLIT."""
    out = [_count([(key, n)])]
    while len(out) <= DEPTH - SPLIT:
        out.append(_count([(_shorter(out[-1][0]), out[-1][1])]))
    return out


def _weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log-probability of inner nodes, and the posterior that contexts need not be longer there."""
    own = kt_log(zeros, ones)
    whole = np.logaddexp(own, below) - np.log(2)
    return whole, np.exp(np.minimum(0, own - np.log(2) - whole))


def _upwards(strings: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, ...]]:
    """(node, zeros, ones, whole, weight) of the k-th bit, from the greatest depth down to SPLIT."""
    out: list[tuple[np.ndarray, ...]] = []
    for s, n in strings:
        node, bit = _prefix(s, k), (s >> (7 - k)) & 1
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        zeros, ones = (np.add.reduceat(np.where(bit == b, n, 0), starts) if len(node) else np.empty(0, np.int64) for b in (0, 1))
        node = node[starts]
        if out:
            below = np.bincount(np.searchsorted(node, _shorter(out[-1][0])), out[-1][3], len(node))
            whole, weight = _weighed(zeros, ones, below)
        else:
            whole, weight = kt_log(zeros, ones), np.ones(len(node))
        out.append((node, zeros, ones, whole, weight))
    return out


def _downwards(zeros, ones, weight, gathered, left):
    """The chance of a one where a node is the deepest known; what is gathered and left for deeper ones."""
    own = (ones + 0.5) / (zeros + ones + 1)
    return gathered + left * own, gathered + left * weight * own, left * (1 - weight)


def keyed(strings: DataFrame, shares: int) -> DataFrame:
    """(share, key, n) of (code, n)."""
    turned = " | ".join(["(code & 255)", *(f"shiftleft(shiftright(code, {8 * i}) & 255, {8 * (DEPTH + 1 - i)})" for i in range(1, DEPTH + 1))])
    rows = strings.select(F.expr(turned).alias("key"), "n")
    return rows.select(F.expr(f"(shiftright(key, {8 * (DEPTH + 1 - SPLIT)}) * {_SPREAD} & 65535) % {shares}").alias("share"), "key", "n")


def shallow(strings: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """For the depths below SPLIT: (node, chance of a one, gathered, left), from (share, key, n)."""

    def up(got: pa.Table) -> pa.Table:
        release()
        by_depth = _by_depth(got["key"].to_numpy(), got["n"].to_numpy())
        parts = []
        for k in range(8):
            node, zeros, ones, whole, _ = _upwards(by_depth, k)[-1]
            above, back = np.unique(_shorter(node), return_inverse=True)
            parts.append((above, *(np.bincount(back, x, len(above)) for x in (zeros, ones, whole))))
        return pa.table(dict(zip(("node", "zeros", "ones", "below"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    rows = strings.groupBy("share").applyInArrow(up, "node long, zeros double, ones double, below double")
    rows = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()  # 256 * 255 rows at most
    node, zeros, ones, below = (rows[c].to_numpy() for c in ("node", "zeros", "ones", "below"))
    order = np.argsort(node)
    levels = []
    node, zeros, ones, below = node[order], zeros[order], ones[order], below[order]
    for _ in range(SPLIT):
        whole, weight = _weighed(zeros, ones, below)
        levels.append((node, zeros, ones, weight))
        node, back = np.unique(_shorter(node), return_inverse=True)
        zeros, ones, below = (np.bincount(back, x, len(node)) for x in (zeros, ones, whole))
    out: list[tuple[np.ndarray, ...]] = []
    for node, zeros, ones, weight in reversed(levels):
        up_at = np.searchsorted(out[-1][0], _shorter(node)) if out else None
        gathered, left = (out[-1][2][up_at], out[-1][3][up_at]) if out else (np.zeros(len(node)), np.ones(len(node)))
        out.append((node, *_downwards(zeros, ones, weight, gathered, left)))
    return out


def lengths(key: np.ndarray, strings: list[tuple[np.ndarray, np.ndarray]], top: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Natural logarithm of the model's probability of each byte after its context; all strings of the share are given.

    A context that was never seen is as its parent; without any training the byte costs eight bits.
    """
    total = np.zeros(len(key))
    for k in range(8):
        known = list(top)
        for node, zeros, ones, _, weight in reversed(_upwards(strings, k)):
            up_at = np.searchsorted(known[-1][0], _shorter(node))
            known.append((node, *_downwards(zeros, ones, weight, known[-1][2][up_at], known[-1][3][up_at])))
        chance, wanted, open_ = np.full(len(key), 0.5), _prefix(key, k), np.ones(len(key), bool)
        for node, ended, _, _ in reversed(known):
            at, there = _at(node, wanted)
            there &= open_
            chance[there] = ended[at[there]]
            open_ &= ~there
            wanted = _shorter(wanted)
        total += np.log(np.where((key >> (7 - k)) & 1, chance, 1 - chance))
    return total


def answers(asked: DataFrame, strings: DataFrame, top: Broadcast) -> DataFrame:
    """(chunk, keys, values) with the code length of each key of asked (chunk, share, keys)."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        sent = [_unpacked([b]) for b in left["keys"].to_pylist()]
        if not sent:
            return pa.table({"chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})
        key = np.unique(np.concatenate(sent))
        value = lengths(key, _by_depth(right["key"].to_numpy(), right["n"].to_numpy()), top.value)
        found = [value[np.searchsorted(key, k)].astype(np.float32).tobytes() for k in sent]
        return pa.table({"chunk": left["chunk"], "keys": left["keys"], "values": pa.array(found, pa.binary())})

    return asked.groupBy("share").cogroup(strings.groupBy("share")).applyInArrow(look, "chunk long, keys binary, values binary")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows (doc_id, text) and the chunks of consecutive ones."""
    part = TaskContext.get().partitionId()
    uid, chunk, size = part << 40, part << 24, 0
    for batch in slices(batches, "text", 2_000_000):
        m, n = batch.num_rows, pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size and size + n > CHUNK:
            chunk, size = chunk + 1, 0
        yield _batch([pa.array(range(uid, uid + m), pa.int64()), pa.array([chunk] * m, pa.int64()), *batch.columns], ["uid", "chunk", "doc_id", "text"])
        uid, size = uid + m, size + n


def _asked(chunk: int, key: np.ndarray, shares: int) -> pa.Table:
    """The sorted distinct keys of a chunk, packed by share."""
    share = _share(key, shares)
    order = np.argsort(share, kind="stable")
    share, key = share[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])) if len(key) else np.empty(0, np.int64)
    stops = np.append(starts[1:], len(key))
    packed = [_packed(key[a:b]) for a, b in zip(starts, stops, strict=True)]
    return pa.table({"chunk": pa.array([chunk] * len(starts), pa.int64()), "share": pa.array(share[starts]), "keys": pa.array(packed, pa.binary())})


def model(strings: DataFrame, shares: int = 1) -> tuple[DataFrame, Broadcast, int]:
    """The model of (code, n): strings by share, the shallow nodes, and the number of shares."""
    filed = stored(keyed(strings, shares))
    return filed, strings.sparkSession.sparkContext.broadcast(shallow(filed)), shares


def code_lengths(code: np.ndarray, filed: tuple[DataFrame, Broadcast, int]) -> np.ndarray:
    """Natural logarithm of the model's probability of each byte after its context, for a few strings."""
    strings, top, shares = filed
    key = _keys(code)
    asked = strings.sparkSession.createDataFrame(_asked(0, np.unique(key), shares))
    got = answers(asked, strings, top).toArrow()
    names, values = _unpacked(got["keys"].to_pylist()), np.frombuffer(b"".join(got["values"].to_pylist()), np.float32)
    order = np.argsort(names)
    return values[order][np.searchsorted(names[order], key)]


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Score every row of docs by a model of the texts of train.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the
    text's words and its end). A null or empty text is an end alone. Repeated rows each
    come back. With nothing to train on, every byte costs eight bits and the base is 0.
    """
    spark = docs.sparkSession
    counted = stored(counts(train))
    shares = max(1, round(volume(train)[1] / SHARE))
    strings, top_nodes, _ = model(counted.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), shares)
    dealt = stored(docs.select("doc_id", "text").mapInArrow(_dealt, "uid long, chunk long, doc_id long, text string"))
    words = stored(counted.where("code is null").groupBy("word").agg(F.sum("n").alias("c")))
    n, v = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    ends = words.where("word is null").select("c").first()
    ends = ends[0] if ends else 0
    unit = np.log10(n + v + 1)
    top = words.where(f"word is not null and octet_length(word) <= {HOT_LENGTH}").orderBy(F.desc("c"), "word").limit(HOT_WORDS).toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), (np.log10(top["c"].to_numpy() + 1.0) - unit).tolist(), strict=True)))
    del top
    long = words.where(f"octet_length(word) > {HOT_LENGTH} and c > 1").select(F.unhex(F.md5("word")).alias("name"), "c").orderBy(F.desc("c"), "name").limit(HOT_LONG).toArrow()
    hot_long = spark.sparkContext.broadcast(dict(zip(long["name"].to_pylist(), (np.log10(long["c"].to_numpy() + 1.0) - unit).tolist(), strict=True)))
    end_score = float(np.log10(ends + 1) - unit)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, []
        for batch in slices(batches, "text", 2_000_000):
            chunk = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)], strict=True):
                if seen and held != chunk[start]:
                    yield from _asked(held, np.unique(np.concatenate(seen)), shares).to_batches()
                    seen = []
                held = int(chunk[start])
                seen.append(np.unique(keys([tokens(t) for t in batch.column(1).slice(start, stop - start).to_pylist()])[0]))
        if seen:
            yield from _asked(held, np.unique(np.concatenate(seen)), shares).to_batches()

    def rate(got: pa.Table, told: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORED.split(", ")]
        known_words, long_words = hot.value, hot_long.value
        string, value = _unpacked(told["keys"].to_pylist()), np.frombuffer(b"".join(told["values"].to_pylist()), np.float32)
        order = np.argsort(string)
        string, value, out = string[order], value[order], []
        for batch in slices(got.to_batches(), "text", 2_000_000):
            uids, ids = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()
            split = [tokens(t) for t in batch.column("text").to_pylist()]
            code, which = keys(split)
            packed = np.sort((code << _DOC) | which)
            code, which = packed >> _DOC, packed & ((1 << _DOC) - 1)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            each = np.repeat(value[np.searchsorted(string, code[starts])], np.diff(np.append(starts, len(code))))
            scores = np.bincount(which, each, len(ids)) / np.log(10)
            known, base, rare_uid, rare_word, rare_times = [], [], [], [], []
            for k, w in enumerate(split):
                times = Counter(w)
                total, seen = end_score, int(ends > 0)
                for word, t in times.items():
                    s = known_words.get(word) if len(word) <= HOT_LENGTH else long_words.get(hashlib.md5(word).digest())
                    if s is None:
                        rare_uid.append(uids[k])
                        rare_word.append(word)
                        rare_times.append(t)
                    else:
                        total += t * s
                        seen += t
                known.append(seen)
                base.append(total)
            m, r = len(ids), len(rare_uid)
            held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
            own = [b" %d" % u for u in uids]  # no word holds a blank: joined with nothing, and spread out
            out.append(_batch([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(held), pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(own, pa.binary()), pa.nulls(m, pa.int64())], names))
            out.append(_batch([pa.array(rare_uid, pa.int64()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.bool_()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.float64()), pa.nulls(r, pa.float64()), pa.array(rare_word, pa.binary()), pa.array(rare_times, pa.int64())], names))
        return pa.Table.from_batches(out)

    asked = dealt.select("chunk", "text").mapInArrow(ask, "chunk long, share long, keys binary")
    told = answers(asked, strings, top_nodes)
    rated = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(rate, SCORED)
    joined = rated.join(words.where("word is not null"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.coalesce(F.sum(F.when(c > 0, F.col("times"))), F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.max("base") + F.coalesce(F.sum(F.col("times") * (F.log10(c + 1) - F.lit(float(unit)))), F.lit(0.0))).alias("base_score"),
            F.max("score").alias("score"),
        )
        .drop("uid")
    )


def op6_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, docs.where(~held_out(F.col("doc_id"), 7, 2)))
