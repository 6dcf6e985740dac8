"""Times as they come: epoch seconds or milliseconds, and a few text forms, to epoch milliseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms, tried in this order (strptime and Spark spelling).
FORMATS = (
    ("%Y%m%d %H%M%S", "yyyyMMdd HHmmss"),
    ("%Y%m%d%H%M%S", "yyyyMMddHHmmss"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"),
    ("%Y-%m-%d", "yyyy-MM-dd"),
    ("%Y%m%d", "yyyyMMdd"),
)
#: Numbers above are milliseconds, others seconds, unless the unit is stated.
MILLIS_FROM = 1_000_000_000_000


def parse_time(value, unit: str | None = None) -> int | None:
    """Epoch milliseconds of None, a datetime (naive: UTC), a number or a text. unit: "s" or "ms" for
    numbers; without it, those up to 1e12 count as seconds."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return int((value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp() * 1000)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value) if unit == "ms" or (unit is None and value > MILLIS_FROM) else int(value * 1000)
    if isinstance(value, str):
        text = re.sub(r"\s+", " ", value.strip())
        for form, _ in FORMATS:
            try:
                return int(datetime.strptime(text, form).replace(tzinfo=UTC).timestamp() * 1000)
            except ValueError:
                continue
        raise ValueError(f"not a time: {value!r}")
    raise TypeError(f"not a time: {type(value).__name__}")


#: Each form's shape, so that no form matches a text meant for another.
_SHAPES = (r"^\d{8} \d{6}$", r"^\d{14}$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d$", r"^\d{8}$")


def parse_time_column(text: Column) -> Column:
    """Epoch milliseconds of a text column, as parse_time() has it, NULL where no form fits."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    tries = [F.when(t.rlike(shape), F.to_timestamp_ntz(F.when(t.rlike(shape), t), F.lit(form))) for shape, (_, form) in zip(_SHAPES, FORMATS, strict=True)]
    out = F.coalesce(*tries)
    days, origin = F.datediff(out.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.lit(86_400_000)
    return days * origin + (F.hour(out) * 3600 + F.minute(out) * 60 + F.second(out)) * 1000


def ms_to_date(ms: Column) -> Column:
    """The UTC date of epoch milliseconds, as yyyy-MM-dd."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")


#: Milliseconds of a unit; months and years have no fixed length.
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as "1h", "15m" or "2 d"; a bare unit is one of it."""
    m = re.fullmatch(r"\s*(\d*)\s*([a-z]+)\s*", text.lower())
    if not m or m[2] not in _UNITS or m[1] == "0":
        raise ValueError(f"not a duration of fixed length: {text!r}")
    return int(m[1] or 1) * _UNITS[m[2]]
