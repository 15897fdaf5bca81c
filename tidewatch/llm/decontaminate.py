"""Benchmark decontamination: find windows of test items in documents with one Aho-Corasick automaton.

Items and documents are brought to one line of lower-cased words between single blanks. The windows of all items
go into an automaton, which reads each document's line once; a match ends in a word, and words know where they
stand in the original text. The automaton's size is bounded: where the windows of a benchmark have more bytes, they
are dealt to several automata, and the documents are read once for each, with what was found carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices, stored, table
from .word_bytes import WORD, words

#: Bytes of windows (and of their lists of items) in one automaton, which takes about 50 times as many in memory.
AUTOMATON_BYTES = 4 << 20
#: Words of a window.
WINDOW = 10
_FOUND = "struct<n_words:long, n_hit:long, items:array<string>, spans:array<struct<start:int, length:int>>>"
_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of `size` words of all items, or whole shorter items: window, n (its words), items (distinct ids as text)."""
    found = F.regexp_extract_all(fold(F.col(text).cast("string")), F.lit(WORD), F.lit(0))
    each = items.select(F.col(item_id).cast("string").alias("item"), found.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    each = each.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window"))
    return each.groupBy("window").agg(F.size(F.split("window", " ")).alias("n"), F.sort_array(F.collect_set("item")).alias("items"))


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, rows: list[tuple]) -> ahocorasick.Automaton | None:
    """The automaton of these windows, made once in each worker; None where there are none."""
    if key not in _BUILT:
        found = ahocorasick.Automaton()
        for number, (window, n, _) in enumerate(rows):
            found.add_word(f" {window} ", (number, n))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key] if rows else None


def _matches(line: str, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs (first word, last word) that windows cover, merged, and the windows found."""
    runs, found, blanks, upto = [], set(), 0, 0
    for end, (number, n) in automaton.iter(line):
        blanks += line.count(" ", upto, end + 1)
        upto = end + 1
        last = blanks - 2
        first = last - n + 1
        while runs and runs[-1][1] >= first - 1:  # ends only grow, starts may go back
            first = min(first, runs.pop()[0])
        runs.append((first, last))
        found.add(number)
    return runs, found


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted([*a, *b]):
        if out and out[-1][1] >= first - 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _pass(docs: DataFrame, patterns: Broadcast, before: bool, last: bool, keep: list[str]) -> DataFrame:
    """Read every text with one automaton; `before`: a column "_runs" holds what others found; `last`: give results."""
    key = uuid.uuid4().hex
    kind = _FOUND if last else "struct<runs:array<struct<first:int, last:int>>, items:array<string>>"
    kept = [f for f in docs.schema.fields if f.name in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = patterns.value
        automaton = _automaton(key, rows)
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            w = words(texts)
            bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
            earlier = batch.column("_found").to_pylist() if before else [None] * len(texts)
            out = []
            for i, old in enumerate(earlier):
                a, b = bounds[i], bounds[i + 1]
                runs, items = ([(r["first"], r["last"]) for r in old["runs"]], set(old["items"])) if old else ([], set())
                if a < b and automaton is not None:
                    line = w.line[w.at[a] - 1 : w.at[b - 1] + w.size[b - 1] + 1].tobytes().decode("utf-8", "replace")
                    new, found = _matches(line, automaton)
                    runs = _merged(runs, new) if runs else new
                    items.update(x for number in found for x in rows[number][2])
                if last:
                    spans = _spans(texts[i], w, a, runs) if runs else []
                    out.append({"n_words": int(b - a), "n_hit": sum(y - x + 1 for x, y in runs), "items": sorted(items), "spans": spans})
                else:
                    out.append({"runs": [{"first": x, "last": y} for x, y in runs], "items": sorted(items)})
            names = [f.name for f in kept] + ([] if last else ["_text"])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, _arrow(last))], [*names, "found" if last else "_found"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.mapInArrow(scan, ", ".join([*fields, f"found {kind}"] if last else [*fields, "_text string", f"_found {kind}"]))


def _arrow(last: bool) -> pa.DataType:
    if not last:
        return pa.struct([("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])
    return pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])


def _spans(text: pa.Scalar, w, first_word: int, runs: list[tuple[int, int]]) -> list[dict]:
    """Where runs of words stand in the original text, in characters."""
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    before = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with a byte
    out = []
    for a, b in runs:
        start = w.source[first_word + a]
        end = w.source[first_word + b] + w.size[first_word + b]
        at = int(before[start]) - 1
        out.append({"start": at, "length": int(before[end - 1]) - at})
    return out


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep: list[str] | None = None, item_id: str = "item_id", text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The columns `keep` of docs (all, unless given) and a column found: n_words, n_hit (words inside an occurring window),
    items (ids, as text and in its order, of items with an occurring window), spans (runs of hit words in the original, in characters from 0).

    A null or empty text has no words; neither has an item without words, which then matches nothing. An item with a null id marks words
    but is not named; repeated ids count once. Every row of docs gives one row, repeated or not. A column of docs named found is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "found"]
    spark = docs.sparkSession
    pattern = stored(windows(items, size, item_id, text))
    weight = F.octet_length("window") + 2 + F.coalesce(F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 8), F.lit(0))
    total = pattern.agg(F.sum(weight)).first()[0] or 0
    automata = max(1, -(-total // automaton_bytes))
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    for k in range(automata):
        share = pattern.where(F.pmod(F.xxhash64("window"), F.lit(automata)) == k)
        found = spark.sparkContext.broadcast([(r.window, r.n, r["items"]) for r in share.toLocalIterator()])
        last = k == automata - 1
        rows = _pass(rows, found, k > 0, last, keep)
        rows = rows if last else stored(rows)
    return rows


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in ten-word windows of benchmark items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.sha2(F.array_join("found.items", ","), 256)
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH doc AS (
    SELECT row_number() OVER () AS nr, doc_id, coalesce({_WORDS}, []) AS words FROM documents
), item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words, least(10, len(words)) AS n FROM benchmark
), pattern AS (
    SELECT DISTINCT item, n, array_to_string(words[spot : spot + n - 1], ' ') AS line
    FROM item, LATERAL unnest(range(1, len(words) - n + 2)) AS u(spot) WHERE n > 0
), held AS (
    SELECT nr, spot, n, array_to_string(words[spot : spot + n - 1], ' ') AS line
    FROM doc, (SELECT DISTINCT n FROM pattern) AS sizes, LATERAL unnest(range(1, len(words) - n + 2)) AS u(spot)
), met AS (
    SELECT nr, spot, h.n, item FROM held h JOIN pattern p ON h.n = p.n AND h.line = p.line
), hit AS (
    SELECT nr, count(DISTINCT place) AS n_hit
    FROM (SELECT DISTINCT nr, spot, n FROM met) AS m, LATERAL unnest(range(spot, spot + n)) AS u(place) GROUP BY nr
), named AS (
    SELECT nr, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY nr
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (nr) LEFT JOIN named USING (nr)
"""
