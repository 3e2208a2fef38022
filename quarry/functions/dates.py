"""Date-time parsing: the default layouts, named parsers and translations of other format languages."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in order where no format is given.
DEFAULT = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd")
EPOCHS = {"unix_sec": F.timestamp_seconds, "epoch_second": F.timestamp_seconds, "unix_milli": F.timestamp_millis, "epoch_millis": F.timestamp_millis, "unix_micro": F.timestamp_micros, "unix_nano": lambda c: F.timestamp_micros(F.floor(c / 1000))}
NAMED = {"strict_date": "yyyy-MM-dd", "date": "yyyy-MM-dd", "basic_date": "yyyyMMdd", "strict_date_time": DEFAULT[0], "date_time": DEFAULT[0], "date_hour_minute_second": "yyyy-MM-dd'T'HH:mm:ss", "year_month": "yyyy-MM", "year": "yyyy"}
_PERCENT = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "XX", "Z": "VV", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}
_LAYOUT = (("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("Z07:00", "XXX"), ("-0700", "Z"), ("-07:00", "XXX"), ("MST", "z"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"))


def percent_style(fmt: str) -> str:
    """A strftime format as a Spark pattern."""
    return re.sub(r"%(.)|([A-Za-z]+)", lambda m: _PERCENT[m[1]] if m[1] else f"'{m[2]}'", fmt)


def layout_style(fmt: str) -> str:
    """A reference-time layout as a Spark pattern."""
    out, i = "", 0
    while i < len(fmt):
        for a, b in _LAYOUT:
            if fmt.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def parse(c: Column, fmt: str | None = None) -> Column:
    """Timestamps of a string or number column; alternatives are separated by ||; null where nothing fits."""
    if not fmt:
        return F.coalesce(*(F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in DEFAULT))
    parts = []
    for f in fmt.split("||"):
        if f in EPOCHS:
            parts.append(EPOCHS[f](c.try_cast("long")))
        else:
            f = NAMED.get(f, f)
            f = percent_style(f) if "%" in f else layout_style(f) if "2006" in f else f
            parts.append(F.try_to_timestamp(c.cast("string"), F.lit(f)))
    return F.coalesce(*parts)


def parse_literal(v: Any, fmt: str | None = None) -> Column:
    return F.lit(v).cast("timestamp") if not isinstance(v, (str, int, float)) else parse(F.lit(v), fmt)
