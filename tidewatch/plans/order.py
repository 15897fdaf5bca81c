"""Total orders, pages and their metadata, and query identity."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections import OrderedDict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import strict

PAGE, MOST = 100, 1_000


def total_order(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Time first, unparsed last, then every column ascending: no two different rows tie."""
    columns = columns or df.columns
    head = [strict(F.col("Timestamp")).asc_nulls_last()] if "Timestamp" in df.columns else []
    return head + [F.col(c).asc_nulls_last() for c in columns]


def search_order(df: DataFrame) -> list[Column]:
    """Time, then record and event ids as numbers, then every column."""
    numbers = [F.expr(f"try_cast({c} AS bigint)").asc_nulls_last() for c in ("RecordID", "EventID") if c in df.columns]
    order = total_order(df)
    return order[:1] + numbers + order[1:]


def page(df: DataFrame, order: list[Column], size: int = PAGE, offset: int = 0) -> DataFrame:
    if not 1 <= size <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows and starts at 0 or later")
    return df.orderBy(*order).offset(offset).limit(size)


def _canonical(value):
    """A value as JSON can hold it, the same for equal arguments: sequences as lists, sets sorted, columns and tables by their expressions."""
    if isinstance(value, dict):
        return {str(k): _canonical(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_canonical(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((_canonical(v) for v in value), key=repr)
    if isinstance(value, DataFrame):
        return {"columns": value.columns, "plan": value.semanticHash()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def query_hash(operator: str, **arguments) -> str:
    """SHA-256 of an operator's name and arguments in canonical form; page numbers are not among them."""
    return hashlib.sha256(json.dumps([operator, _canonical(arguments)], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Asked(NamedTuple):
    """A query with its identity: all pages of it have one hash."""

    rows: DataFrame
    order: list[Column]
    hash: str


def ask(operator: Callable[..., DataFrame], logs: DataFrame, *args, by: Callable[[DataFrame], list[Column]] = total_order, **kwargs) -> Asked:
    """Call an operator on logs; its name, its arguments (defaults filled in) and its order make the hash.

    Arguments given by place, by name or by default are the same query; a different filter, order or set of columns is another.
    """
    name = f"{operator.__module__}.{operator.__qualname__}"
    if "<lambda>" in name:
        raise ValueError("an operator needs a name")
    bound = inspect.signature(operator).bind(logs, *args, **kwargs)
    bound.apply_defaults()
    rows = operator(logs, *args, **kwargs)
    order = by(rows)
    rest = dict(list(bound.arguments.items())[1:])
    return Asked(rows, order, query_hash(name, arguments=rest, order=[str(c) for c in order], columns=rows.columns))


class Hint(NamedTuple):
    """A count that a caller has from an earlier page."""

    total: int
    query_hash: str
    dataset_version: str


class Counts:
    """Counts of queries already paged, by query hash and dataset version; the oldest ones go first."""

    def __init__(self, most: int = 1_000):
        self._held: OrderedDict[tuple[str, str], int] = OrderedDict()
        self._most = most

    def get(self, asked: Asked, version: str) -> tuple[int, str]:
        """The count and where it comes from; without a dataset version nothing is kept."""
        key = (asked.hash, version)
        if version and key in self._held:
            self._held.move_to_end(key)
            return self._held[key], "cache"
        n = asked.rows.count()
        if version:
            self._held[key] = n
            while len(self._held) > self._most:
                self._held.popitem(last=False)
        return n, "count_query"


def paged(df: DataFrame | Asked, order: list[Column] | None = None, name: str = "", size: int = PAGE, offset: int = 0, total: int | None = None, version: str = "", counts: Counts | None = None, hint: Hint | None = None, include_total: bool = True, most: int = MOST, empty: str = "No matching rows") -> DataFrame:
    """A page with its metadata on every row, in its order; an empty page is one row of metadata alone.

    The identity of a table that was not asked for by `ask` is made of `name`, its columns, its plan and its order. The count is the
    total given, the hint's where it has this query's hash and this version (else it is counted anew), the one kept in
    `counts`, or a count of the query. Without a total, a full page says that there is more. Columns named like
    the metadata are replaced.
    """
    if isinstance(df, DataFrame):
        order = order or []
        df = Asked(df, order, query_hash(name, table=df, order=[str(c) for c in order]))
    if not 1 <= size <= most or offset < 0:
        raise ValueError(f"a page has 1 to {most} rows and starts at 0 or later")
    if hint is not None and (hint.total < 0 or not hint.query_hash or not hint.dataset_version):
        raise ValueError("a hint is a total of 0 or more with its query hash and dataset version")
    source = "given" if total is not None else "none"
    if hint is not None and (hint.query_hash, hint.dataset_version) == (df.hash, version):
        total, source = hint.total, "hint"
    if total is None and (include_total or hint is not None):
        total, source = (counts or Counts()).get(df, version)
    rows = (df.rows.orderBy(*df.order) if df.order else df.rows).offset(offset).limit(size)
    if total is None:
        returned = rows.count()
        more = returned == size
    else:
        returned = max(0, min(size, total - offset))
        more = offset + returned < total
    message = "" if returned else empty if total == 0 else "No data on the specified page"
    meta = {
        "status": F.lit("ok" if returned else "no_data"),
        "message": F.lit(message),
        "total_count": F.lit(total).cast("long"),
        "has_more": F.lit(more),
        "next_offset": F.lit(offset + returned if more else None).cast("long"),
        "page_size": F.lit(size),
        "page_offset": F.lit(offset),
        "query_hash": F.lit(df.hash),
        "dataset_version": F.lit(version),
        "count_source": F.lit(source),
    }
    if not returned:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        rows = rows.sparkSession.range(1).select(*nothing)
    return rows.withColumns(meta)
