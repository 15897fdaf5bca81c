"""Which of many strings occur in texts: one automaton over the strings, one pass over the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Bytes of strings in one automaton, which takes about 50 times as many in memory; more are dealt to several, each with its own pass.
AUTOMATON_BYTES = 4 << 20
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, strings: list[str]) -> ahocorasick.Automaton:
    """The automaton of some strings, made once in each worker."""
    if key not in _BUILT:
        found = ahocorasick.Automaton()
        for s in strings:
            found.add_word(s, s)
        found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key]


def occurring(texts: DataFrame, text: str, strings: DataFrame, string: str, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The distinct strings (one column, as named) that are substrings of at least one text, case and all.

    Nulls and empty strings occur nowhere. Each task reports a string once; no pair of a text and a string is made.
    """
    wanted = stored(strings.select(F.col(string).alias("s")).where("s <> ''").distinct())
    total = wanted.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    shares = max(1, -(-total // automaton_bytes))
    lines = texts.select(F.col(text).alias("t")).where("t <> ''")

    def scan(share: int) -> DataFrame:
        held = [r.s for r in wanted.where(F.pmod(F.xxhash64("s"), F.lit(shares)) == share).toLocalIterator()]  # a bounded share
        patterns, key = texts.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[str] = set()
            for batch in batches:
                for t in batch.column("t").to_pylist() if patterns.value else ():
                    seen.update(s for _, s in _automaton(key, patterns.value).iter(t))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["s"])

        return lines.mapInArrow(found, "s string")

    out = scan(0)
    for share in range(1, shares):
        out = out.union(scan(share))
    return out.distinct().withColumnRenamed("s", string)
