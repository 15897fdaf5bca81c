"""N-gram Jaccard join: links between documents whose 5-word shingle sets have similarity 0.8 or more.

1. Shingles are counted over all documents, to know which are widespread. Their hashes travel as packed
   arrays, one for each share of the hash space, and are sorted and counted there.
2. Every distinct set shows the keys of its parity sketch (see parity.py); sets with a common key meet.
   In each such bucket, all others are paired with the smallest: a star, not all pairs.
3. Pairs are tested by the Hamming distance of small bit sketches, and those that pass by the exact sets.
4. Buckets in which a pair failed may still hold similar sets in different components. Their members are
   compared block against block within a task, by sketches and then exactly; a task unites components as it
   finds links and gives fewer links than it has members, so no link is lost and none is given twice over.
5. On demand, all links are counted for each document: components are compared with themselves, block
   against block.

Documents with equal sets share one set id throughout; they are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, packed, release, slices, slices_of, stored, table, two_to, unpacked, volume
from .components import components
from .parity import keys_of, similar
from .shingles import mixed, set_id, shingle_sets

#: A shingle is widespread if more documents than this hold it.
FEW = 4
#: Widespread shingles are marked in a bitmap of 2^27 bits (16 MB), whatever the size of the input. Two
#: shingles may share a bit: that changes which keys are shown first, not the result.
BITS = 27
#: Bytes of text to a share.
SHARE = 24_000_000
#: Ids of texts to fetch again are broadcast up to so many (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_U32 = np.uint64(0xFFFFFFFF)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _shares(h: np.ndarray, bits: int) -> list[int]:
    """Where each share begins in sorted hashes; shares are given by the highest bits."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return [0, *np.searchsorted(h, bounds).tolist(), len(h)]


def census(docs: DataFrame, bits: int) -> DataFrame:
    """(share, marks): slices of the bitmap of widespread shingles; (doc_id, set, n): the set of each document.

    Both come from one pass over the texts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("share", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())]
        for k, batch in enumerate(slices(batches, "text", 1_000_000)):
            sets = shingle_sets(batch.column(1).to_pylist())
            ids = [(i, set_id(s), len(s)) for i, s in zip(batch.column(0).to_pylist(), sets, strict=True) if i is not None]
            h = np.sort(np.concatenate(sets))
            at = _shares(h, bits)
            h = ((h >> np.uint64(32 - bits)) & _U32).astype(np.uint32)
            rows = [(share, h[a:b].tobytes(), None) for share, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            own = ids[0][0] + k if ids else 0
            rows.append((-1 - own % (1 << bits), None, np.array(ids, np.int64).tobytes()))
            yield _batch(rows, fields)

    def count(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        release()
        if key[0] < 0:
            x = np.concatenate([np.frombuffer(b, np.int64) for b in got["docs"]]).reshape(-1, 3)
            return pd.DataFrame({"share": None, "marks": None, "doc_id": x[:, 0], "set": x[:, 1], "n": x[:, 2]})
        h = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in got["hashes"]]))
        # In sorted order, a hash that stands FEW places further too is held by more than FEW documents.
        wide = h[:-FEW][h[FEW:] == h[:-FEW]] if len(h) > FEW else h[:0]
        marks = packed(wide >> np.uint32(32 - (BITS - bits)), BITS - bits)
        return pd.DataFrame({"share": [key[0]], "marks": [marks], "doc_id": None, "set": None, "n": None})

    dealt = docs.select("doc_id", "text").mapInArrow(read, "share int, hashes binary, docs binary")
    return dealt.groupBy("share").applyInPandas(count, "share int, marks binary, doc_id long, set long, n long")


def buckets(docs: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """(bucket, set): the sets under each key that more than one set shows; equal buckets are one."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("share", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())]
        seen: set[int] = set()
        marks = unpacked(shared.value, BITS)
        for batch in slices(batches, "text", 1_000_000):
            sets = shingle_sets(batch.column(0).to_pylist())
            everything = np.concatenate(sets)
            at = everything >> np.uint64(64 - BITS)
            wide = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            keys, names, start = [], [], 0
            for s in sets:
                stop = start + len(s)
                name = set_id(s)
                if name not in seen:  # a copy shows nothing new
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name)
                    k = keys_of(s, wide[start:stop])
                    keys.append(k)
                    names.append(np.full(len(k), name, np.int64))
                start = stop
            if not keys:
                continue
            k, n = mixed(np.concatenate(keys)), np.concatenate(names)
            order = np.argsort(k)
            k, n = k[order], n[order]
            at = _shares(k, bits)
            k = ((k >> np.uint64(32 - bits)) & _U32).astype(np.uint32)
            yield _batch([(share, k[a:b].tobytes(), n[a:b].tobytes()) for share, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a], fields)

    def meet(got: pd.DataFrame) -> pd.DataFrame:
        release()
        k = np.concatenate([np.frombuffer(b, np.uint32) for b in got["keys"]])
        s = np.concatenate([np.frombuffer(b, np.int64) for b in got["sets"]])
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[keep], s[keep]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        with np.errstate(over="ignore"):
            names = np.add.reduceat(mixed(s.view(np.uint64)), starts)  # a bucket is named by its members
        _, first = np.unique(names, return_index=True)
        chosen = np.zeros(len(starts), bool)
        chosen[first] = True
        chosen &= sizes > 1
        member = np.repeat(chosen, sizes)
        return pd.DataFrame({"bucket": np.repeat(names, sizes)[member].view(np.int64), "set": s[member]})

    dealt = docs.select("text").mapInArrow(show, "share int, keys binary, sets binary")
    return dealt.groupBy("share").applyInPandas(meet, "bucket long, set long").distinct()


def _sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set: a power of two of at least twice as many bits as shingles."""
    size = 1 << max(6, int(len(h)).bit_length() + 1)
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the larger folded onto the smaller: never above the sets' difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, n, sketch, hashes) of the wanted (doc_id, set): their texts are read again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("set", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("hashes", pa.binary())]
        for batch in slices(batches, "text", 1_000_000):
            sets = shingle_sets(batch.column(1).to_pylist())
            names = batch.column(0).to_pylist()
            rows = [(name, len(s), _sketch(s), s.tobytes()) for name, s in zip(names, sets, strict=True) if set_id(s) == name]
            yield _batch(rows, fields)

    few = wanted.count() <= BROADCAST_IDS
    side = wanted.select("doc_id", "set")
    return docs.select("doc_id", "text").join(F.broadcast(side) if few else side, "doc_id").select("set", "text").mapInArrow(read, "set long, n long, sketch binary, hashes binary")


def tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) for each pair of sets: first by sketches, then, where those allow a link, exactly."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i).to_pylist() for i in range(2, 6))
            ok = [5 * min(i, j) >= 4 * max(i, j) and _apart(s, t) <= (i + j) // 9 for i, s, j, t in zip(n, x, m, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "close"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    small = sets.select("set", "n", "sketch")
    left = small.toDF("a", "n", "x")
    right = small.toDF("b", "m", "y")
    close = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(near, "a long, b long, close boolean"))
    whole = sets.select("set", "hashes")
    linked = close.where("close").select("a", "b").join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long, linked boolean")
    return linked.union(close.where("not close"))


#: Members of a group to a block and bytes of their hashes to one; rows to a share.
BLOCK, BLOCK_BYTES, SHARE_ROWS = 2_000, 4_000_000, 10_000


def blocked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, set, n, ..) once for each pair of blocks (lo, hi) of their group; own is the block of a row.

    Groups of up to BLOCK members and BLOCK_BYTES of hashes are one block.
    """
    need = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(need)).cast("int").alias("blocks"))
    rows = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")


def shared_out(rows: DataFrame, group: str, shares: int) -> DataFrame:
    """rows with a share: the rows of a pair of blocks have the same one."""
    return rows.withColumn("share", F.pmod(F.xxhash64(group, "lo", "hi"), F.lit(max(1, shares))))


def groups_of(got: pd.DataFrame, group: str) -> Iterator["Block"]:
    """The pairs of blocks of a share that hold more than one set."""
    column = {c: got[c].to_numpy() for c in got.columns}
    order = np.lexsort([column[c] for c in ("set", "n", "hi", "lo", group)])
    column = {c: x[order] for c, x in column.items()}
    new = np.ones(len(order), bool)
    for k, c in enumerate((group, "lo", "hi")):
        differ = column[c][1:] != column[c][:-1]
        new[1:] = differ | new[1:] if k else differ
    keep = np.ones(len(order), bool)
    keep[1:] = new[1:] | (column["set"][1:] != column["set"][:-1])  # a set that came twice
    column = {c: x[keep] for c, x in column.items()}
    starts = np.flatnonzero(new[keep])
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), int(keep.sum())], strict=True):
        if stop - start > 1:
            yield Block({c: x[start:stop] for c, x in column.items()})


class Block:
    """The sets of one pair of blocks in the order of their sizes, ready to be compared."""

    def __init__(self, part: dict[str, np.ndarray]):
        self.part, self.n, self.own, self.names = part, part["n"], part["own"], part["set"]
        self.across = part["lo"][0] != part["hi"][0]
        if "hashes" in part:
            hashes = [np.frombuffer(b, np.uint64) for b in part["hashes"]]
            # Every hash as a small number: a set is then marked in one array and looked up by all others.
            every, code = np.unique(np.concatenate(hashes), return_inverse=True)
            self.codes = np.split(code.astype(np.int32), np.cumsum(self.n)[:-1])
            self.mark = np.zeros(len(every), bool)

    def allowed(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, ok): for some sets from the i-th on, which sets after each are of fit size and have a near enough sketch."""
        step = 256
        for i in range(0, len(self.n), step):
            first = min(step, len(self.n) - i)
            stop = int(np.searchsorted(self.n, self.n[i + first - 1] * 5 // 4, "right"))
            sketches = self.part["sketch"][i:stop]
            size, count = len(sketches[0]), stop - i
            if len(sketches[-1]) == size:
                folded = np.frombuffer(b"".join(sketches), np.uint64).reshape(count, -1)
            else:
                parts = [np.frombuffer(b, np.uint64) for b in sketches]
                folded = np.stack([x if x.nbytes == size else np.bitwise_xor.reduce(x.reshape(-1, size // 8)) for x in parts])
            n = self.n[i:stop]
            ok = 4 * n <= 5 * n[:first, None]
            ok &= np.arange(count) > np.arange(first)[:, None]
            if self.across:
                ok &= self.own[i : i + first, None] != self.own[i:stop]
            if not ok.any():
                continue
            width = max(1, 4_000_000 // (first * folded.shape[1]))
            for j in range(0, count, width):
                cols = slice(j, j + width)
                apart = np.bitwise_count(folded[:first, None] ^ folded[None, cols]).sum(2, dtype=np.int32)
                ok[:, cols] &= apart * 9 <= n[:first, None] + n[cols]
            yield i, ok

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others the i-th set is linked with, exactly."""
        if not len(others):
            return others
        self.mark[self.codes[i]] = True
        hit = self.mark[np.concatenate([self.codes[j] for j in others.tolist()])]
        self.mark[self.codes[i]] = False
        starts = np.cumsum(self.n[others]) - self.n[others]
        common = np.add.reduceat(hit, starts, dtype=np.int64)
        return others[100 * common >= 80 * (self.n[i] + self.n[others] - common)]


def further(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between members of one bucket in different components, from (bucket, set, component).

    First the members are found that have another one of a different component within reach of their
    sketches; members within reach of each other, over all buckets, are a group. Each group is then
    compared once by the exact sets. A link found joins two components at once, so a pair of blocks gives
    fewer links than it has members, and leaves no two members apart that are linked.
    """
    small = sets.select("set", "n", "sketch")
    rows = blocked(held.join(sets.select("set", "n"), "set"), "bucket").drop("n").join(small, "set")

    def reach(got: pd.DataFrame) -> pd.DataFrame:
        release()
        out = [np.empty((3, 0), np.int64)]
        for block in groups_of(got, "bucket"):
            component = block.part["component"]
            if (component == component[0]).all():
                continue
            group, open_ = component.copy(), np.zeros(len(component), bool)
            for at, ok in block.allowed():
                ok &= component[at : at + len(ok), None] != component[at : at + ok.shape[1]]
                open_[at : at + len(ok)] |= ok.any(1)
                open_[at : at + ok.shape[1]] |= ok.any(0)
                for i in np.flatnonzero(ok.any(1)).tolist():
                    others = np.unique(group[at : at + ok.shape[1]][ok[i]])
                    if len(others) > 1 or others[0] != group[at + i]:
                        group[np.isin(group, others)] = group[at + i]
            names, group = block.names[open_], group[open_]
            if len(names):
                _, first, back = np.unique(group, return_index=True, return_inverse=True)
                out.append(np.stack([names, names[first][back], component[open_]]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["a", "b", "component"])

    def join(got: pd.DataFrame) -> pd.DataFrame:
        release()
        out: list[tuple[int, int]] = []
        for block in groups_of(got, "group"):
            label = block.part["component"].copy()
            for at, ok in block.allowed():
                for i, row in enumerate(ok, at):
                    others = np.flatnonzero(row) + at
                    others = block.linked(i, others[label[others] != label[i]])
                    joined, first = np.unique(label[others], return_index=True)
                    out += [(int(block.names[i]), int(block.names[j])) for j in others[first].tolist()]
                    if len(joined):
                        label[np.isin(label, joined)] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    dealt = shared_out(rows, "bucket", held.count() // SHARE_ROWS)
    near = stored(dealt.groupBy("share").applyInPandas(lambda got: reach(got.drop(columns="share")), "a long, b long, component long").distinct())
    groups = components(near).toDF("set", "group")
    open_ = near.select(F.col("a").alias("set"), "component").distinct().join(groups, "set")
    exact = blocked(open_.join(sets.select("set", "n"), "set"), "group").drop("n").join(sets, "set")
    dealt = shared_out(exact, "group", groups.count() // (SHARE_ROWS // 5))
    return dealt.groupBy("share").applyInPandas(lambda got: join(got.drop(columns="share")), "a long, b long").distinct()


def link_counts(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, links): how many rows of other sets each set is linked with, from (component, set, copies).

    Linked sets are of one component, so each component is compared with itself, block against block, and
    every pair of sets is met once. Only sums leave a task.
    """
    rows = blocked(groups.join(sets.select("set", "n"), "set"), "component").drop("n")

    def count(got: pd.DataFrame) -> pd.DataFrame:
        release()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for block in groups_of(got, "component"):
            copies, links = block.part["copies"], np.zeros(len(block.n), np.int64)
            for at, ok in block.allowed():
                for i, row in enumerate(ok, at):
                    others = block.linked(i, np.flatnonzero(row) + at)
                    links[i] += copies[others].sum()
                    links[others] += copies[i]
            out.append((block.names, links))
        return pd.DataFrame({"set": np.concatenate([x for x, _ in out]), "links": np.concatenate([x for _, x in out])})

    dealt = shared_out(rows.join(sets, "set"), "component", groups.count() // (SHARE_ROWS // 5))
    found = dealt.groupBy("share").applyInPandas(lambda got: count(got.drop(columns="share")), "set long, links long")
    return found.groupBy("set").agg(F.sum("links").alias("links"))


def jaccard_join(docs: DataFrame, counted_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, set, n_shingles, component_id) and the links between sets (a, b) that were found.

    Links are those tested; sets of one component need not all be tested against each other. With
    counted_links, the documents also have n_links: how many other rows each is linked with, copies
    included, all of them counted. A null or
    empty text has an empty set, no links and its own id as component. Documents with a null id are left
    out, as they cannot be named; repeated rows of one id each come back. Columns other than doc_id and
    text do not matter. An empty table gives empty results.
    """
    _, size = volume(docs)
    bits = slices_of(BITS, size / SHARE)
    counted = stored(census(docs, bits))
    members = counted.where("doc_id is not null").select("doc_id", "set", "n")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(counted.where("marks is not null").select("share", "marks"), 1 << bits))
    classes = stored(members.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))

    held = stored(buckets(docs, shared, bits))
    shared.destroy()
    pivots = held.groupBy("bucket").agg(F.min("set").alias("a"))
    star = held.withColumnRenamed("set", "b").join(pivots, "bucket").where("a <> b")
    sets = stored(fetched(docs, held.select("set").distinct().join(classes, "set")))
    first = stored(tested(star.select("a", "b").distinct(), sets))

    # What stars leave open: members of different components in buckets where a pair failed. Two steps along the
    # stars give labels that only sets of one component share; what they do not unite is compared again.
    near = first.where("linked").groupBy("b").agg(F.min("a").alias("a"))
    labels = near.toDF("set", "a").join(near.toDF("a", "top"), "a", "left").select("set", F.coalesce("top", "a").alias("component"))
    failed = star.join(first.where("not linked"), ["a", "b"]).select("bucket").distinct()
    left = held.join(failed, "bucket").join(labels, "set", "left")
    left = stored(left.select("bucket", "set", F.coalesce("component", "set").alias("component")))
    links = stored(first.where("linked").select("a", "b").union(further(left, sets)))
    comps = components(links)

    known = classes.join(comps.toDF("set", "component"), "set", "left").select("set", "doc_id", "copies", F.coalesce("component", "set").alias("component"))
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = known.join(least, "component").select("set", "component", "copies", "sets", "component_id")
    extra = []
    if counted_links:
        named = stored(named)
        others = link_counts(named.where("sets > 1").select("component", "set", "copies"), sets)
        named = named.join(others, "set", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        extra = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    named = stored(named.select("set", "component_id", *(["n_links"] if counted_links else [])))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return members.join(named, "set", "left").select("doc_id", "set", F.col("n").alias("n_shingles"), component, *extra), links


def op1_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), counted_links=True)[0].drop("set")
