"""The two timestamp parsers of detection timelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.fraction offset, with a blank before the offset and one to six digits; else null."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6} [+-]\d{2}:?\d{2}$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(c, r" ([+-]\d{2}):?(\d{2})$", r"$1:$2")))


def lenient(c: Column) -> Column:
    """With T or a blank, with or without fraction (cut to six digits) and offset; else null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"(\.\d{6})\d+", "$1"), r"\s*([+-]\d{2}):?(\d{2})$", r"$1:$2")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(text))


def as_text(c: Column) -> Column:
    """An instant as UTC text: seconds, the fraction without trailing zeros where there is one, and +00."""
    utc = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(utc, r"\.?0+$", ""), F.lit("+00"))


def local_day(c: Column) -> Column:
    """The day in the row's own offset: that of the text."""
    return F.when(lenient(c).isNotNull(), F.to_date(F.substring(F.trim(c), 1, 10)))
