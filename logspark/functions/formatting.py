"""Number / duration / calendar helpers (F11, F22, F23) as column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed3(v) -> Column:
    """integer part, '.', three fraction digits truncated (not rounded)."""
    x = _col(v).cast("double")
    whole = x.cast("bigint")
    frac = F.abs(((x - whole.cast("double")) * F.lit(1000.0)).cast("bigint"))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(frac.cast("string"), 3, "0"))


def percent_text(v) -> Column:
    """fixed3 + '%'."""
    return F.concat(fixed3(v), F.lit("%"))


def rate_percent_text(part, total) -> Column:
    """part / total * 100 as percent text; '0.00%' when total is 0."""
    p, t = _col(part), _col(total)
    rate = p.cast("double") / t.cast("double") * F.lit(100.0)
    return F.when(t > 0, percent_text(rate)).otherwise(F.lit("0.00%"))


def duration_text(seconds) -> Column:
    """'Xh Ym Zs' with leading zero units dropped, from whole seconds."""
    s = _col(seconds).cast("bigint")
    h, m, sec = F.floor(s / 3600).cast("bigint"), (F.floor(s / 60) % 60).cast("bigint"), (s % 60).cast("bigint")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), sec.cast("string"), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), sec.cast("string"), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def month_ago(ts) -> Column:
    """the same wall-clock time one calendar month earlier, with the day
    overflow carried into the next month (31 Mar -> 31 Feb -> 2 or 3 Mar)."""
    t = _col(ts)
    day0 = F.date_add(F.add_months(F.trunc(t, "MM"), -1), F.dayofmonth(t) - 1)
    return day0.cast("timestamp_ntz") + (t - t.cast("date").cast("timestamp_ntz"))


def month_ago_value(ts: _dt.datetime) -> _dt.datetime:
    """Python twin of ``month_ago`` for literal timestamps."""
    y, m = (ts.year, ts.month - 1) if ts.month > 1 else (ts.year - 1, 12)
    first = ts.replace(year=y, month=m, day=1)
    return first + _dt.timedelta(days=ts.day - 1)


def as_timestamp(value) -> Column:
    """A literal point in time (str or datetime) as TIMESTAMP_NTZ."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_as_of(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    return _dt.datetime.fromisoformat(str(value))


def utc_instant(ntz) -> Column:
    """The wall-clock TIMESTAMP_NTZ read as UTC, as a TIMESTAMP - independent
    of the session time zone (a plain cast would shift by its offset, and a
    date_format would go through the session zone, gaps included)."""
    return F.concat(_col(ntz).cast("string"), F.lit("+00:00")).cast("timestamp")


def trunc_ntz(ntz, unit: str) -> Column:
    """Truncate a TIMESTAMP_NTZ to 'day', 'hour', 'minute' or 'second' on the
    wall clock itself (``date_trunc`` would cast through the session zone)."""
    t = _col(ntz)
    if unit == "day":
        return t.cast("date").cast("timestamp_ntz")
    parts = {"hour": (F.hour(t), F.lit(0), F.lit(0)),
             "minute": (F.hour(t), F.minute(t), F.lit(0)),
             "second": (F.hour(t), F.minute(t), F.second(t))}[unit]
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), *parts)


def ntz_text(ntz, sep: str = " ", suffix: str = "") -> Column:
    """yyyy-MM-dd<sep>HH:mm:ss<suffix> of a TIMESTAMP_NTZ, without the zone
    conversion ``date_format`` applies."""
    s = _col(ntz).cast("string")
    return F.concat(F.substring(s, 1, 10), F.lit(sep), F.substring(s, 12, 8), F.lit(suffix))


def utc_wall_clock(instant) -> Column:
    """Inverse of ``utc_instant``: the UTC wall clock of a TIMESTAMP as NTZ."""
    secs = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def epoch_micros(ntz) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock TIMESTAMP_NTZ read as UTC."""
    return F.unix_micros(utc_instant(_col(ntz)))
