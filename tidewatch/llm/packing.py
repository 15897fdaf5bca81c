"""Best-fit decreasing packing of token pieces into sequences.

Documents are tokenised where they lie. Pieces are dealt out evenly by a hash, or, where the order of the
documents counts, by consecutive stretches of it, and each share is packed on its own: longest piece first,
into the fullest sequence that still takes it. A segment tree over the remaining capacities finds that
sequence in logarithmic time. Only numbers are shuffled, never text.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, table, volume

LENGTH = 1024
END = 2
#: Documents to a share, or 4 KB stretches of text where documents are longer than that on the whole: shares
#: keep this size, so their number grows with the input.
SHARE, STRETCH = 20_000, 4_096

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long"
PLACED = PIECE + ", position long"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer's own library gives them.

    Where the file is a byte-level BPE whose ids follow its merges, the same vocabulary is given to tiktoken,
    which takes a quarter of the time. Texts that hold the string of an added token, and those with a
    run of white space too long for tiktoken's splitter, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.odd = re.compile("|".join([*map(re.escape, added), r"\s{100000}"])).search
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        """tiktoken's encoder for the vocabulary, or None where it would not give the same ids."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges") or []]
        extras = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout")
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or spec.get("normalizer") or any(model.get(k) for k in extras) or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        byte = _byte_of()
        kept = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in kept}
        return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.fast(t) if self.fast and not self.odd(t) else self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


class OpenSequences:
    """A segment tree over remaining capacities 0..size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.any = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        i = self.base + capacity
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open sequence with at least this capacity, and that capacity."""
        i, seen = self.base + need, self.any
        if not seen[i]:
            while i > 1 and not (i & 1 == 0 and seen[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if seen[2 * i] else 2 * i + 1
        capacity = i - self.base
        sequence = self.at[capacity].pop()
        if not self.at[capacity]:
            seen[i] = 0
            i >>= 1
            while i and not (seen[2 * i] or seen[2 * i + 1]):
                seen[i] = 0
                i >>= 1
        return sequence, capacity


def best_fit(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, best-fit decreasing; pieces of one length keep their order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, n = OpenSequences(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, n = (n, size), n + 1
        sequence[i], offset[i] = found[0], size - found[1]
        if found[1] > need:
            tree.put(found[1] - need, found[0])
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, size: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; a null text is empty: the end id alone.

    A document of more than `size` ids is cut so that only its first piece is shorter. A column position
    of the documents is carried.
    """
    carried = ["position"] if "position" in docs.columns else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in slices(batches, "text", 2_000_000):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            places = [(p,) for p in batch.column(2).to_pylist()] if carried else [()] * len(texts)
            for doc_id, ids, place in zip(batch.column(0).to_pylist(), ids_of(tokenizer)(texts), places, strict=True):
                ids += end
                n = len(ids) // 4
                at, stop, k = 0, (n - 1) % size + 1, 0
                while at < n:
                    rows.append((doc_id, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]), *place))
                    at, stop, k = stop, stop + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(carried))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(cut, PLACED if carried else PIECE)


def pack(docs: DataFrame, tokenizer: str, size: int = LENGTH) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Repeated rows are packed as often as they occur; an empty table gives an empty result. Sequence ids
    are the share's number times 2^32 plus the number within the share.
    """
    rows, text = volume(docs)
    shares = max(1, round(max(rows, text / STRETCH) / SHARE))

    def fill(key: tuple, share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(share["length"].to_numpy(), size)
        return share.drop(columns="share").assign(sequence_id=sequence + (key[0] << 32), offset=offset)

    dealt = pieces(docs.drop("position"), tokenizer, size).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    return dealt.groupBy("share").applyInPandas(fill, PACKED)


#: Files whose first positions are broadcast, some 200 bytes each.
BROADCAST_FILES = 100_000


def in_written_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the number of each row in the order in which the files hold the table.

    Files count by the number of the task that wrote them, then by name. A table that does not come
    straight from files is stored first.
    """

    def located(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    try:
        rows = located(docs)
    except AnalysisException:
        rows = located(stored(docs))
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    part = F.expr("try_cast(regexp_extract(file, '([0-9]+)[^/]*$', 1) as bigint)")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = stored(files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    few = starts.count() <= BROADCAST_FILES  # else by shuffle
    return rows.join(F.broadcast(starts) if few else starts, "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("position"))


def pack_in_order(docs: DataFrame, tokenizer: str, size: int = LENGTH, share: int = SHARE) -> DataFrame:
    """As pack, but documents meet only within a stretch of `share` of them in the order of the files.

    Stretches are shorter in proportion where documents hold more than STRETCH bytes on average.

    Sequence ids follow that order: stretch by stretch, and within one by the place of the piece that
    begins a sequence. A mix of sources written in order is so kept, to within a stretch.
    """

    rows, text = volume(docs)
    share = max(1, int(share * min(1, max(1, rows) * STRETCH / max(1, text))))

    def fill(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["length", "position", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(got["length"].to_numpy(), size)
        first = offset == 0
        begun = np.lexsort((got["piece"].to_numpy()[first], got["position"].to_numpy()[first]))
        number = np.empty(len(begun), np.int64)
        number[sequence[first][begun]] = np.arange(len(begun))
        return got.drop(columns=["share", "position"]).assign(sequence_id=number[sequence] + (int(key[0]) << 32), offset=offset)

    dealt = pieces(in_written_order(docs), tokenizer, size).withColumn("share", F.expr(f"position div {share}"))
    return dealt.groupBy("share").applyInPandas(fill, PACKED)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
