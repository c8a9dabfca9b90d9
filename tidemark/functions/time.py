"""Durations, relative time expressions, timestamp parsing and date parts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError

# Duration units in seconds.
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

_DURATION = re.compile(r"(\d+)([smhd])")


def duration_seconds(text: str) -> int:
    """``"2h"`` -> 7200."""
    match = _DURATION.fullmatch(text.strip())
    if not match or int(match.group(1)) == 0:
        raise SpecError(f"invalid duration {text!r}, expected <n>s, <n>m, <n>h or <n>d")
    return int(match.group(1)) * _UNIT_SECONDS[match.group(2)]


def duration_micros(text: str) -> int:
    return duration_seconds(text) * 1_000_000


def duration_interval(text: str) -> str:
    """``"2h"`` -> ``"7200 seconds"``, the form ``F.window`` takes."""
    return f"{duration_seconds(text)} seconds"


def _shift(text: str) -> dt.timedelta:
    parts = _DURATION.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise SpecError(f"invalid time offset {text!r}")
    return dt.timedelta(seconds=sum(int(n) * _UNIT_SECONDS[u] for n, u in parts))


def parse_time_expr(value, now: dt.datetime | None = None) -> dt.datetime | None:
    """``now``, ``now -1d2h``, ``now -1d floor 1H`` or an absolute time, as UTC."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    text = value.strip()
    if not text.startswith("now"):
        parsed = dt.datetime.fromisoformat(text)
        return parsed if parsed.tzinfo else parsed.replace(tzinfo=dt.timezone.utc)
    moment = now or dt.datetime.now(dt.timezone.utc)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    body, _, floor = text[3:].partition("floor")
    body = body.replace(" ", "")
    if body:
        if body[0] not in "+-":
            raise SpecError(f"invalid time expression {value!r}")
        offset = _shift(body[1:])
        moment = moment - offset if body[0] == "-" else moment + offset
    if floor:
        unit = floor.strip()
        if not unit[:1].isdigit():
            unit = "1" + unit
        step = duration_seconds(unit.replace("min", "m").replace("T", "m").lower())
        epoch = moment.timestamp()
        moment = dt.datetime.fromtimestamp(epoch - epoch % step, dt.timezone.utc)
    return moment


def ts_literal(value, now: dt.datetime | None = None) -> Column:
    """Timestamp literal for a time expression."""
    moment = parse_time_expr(value, now).astimezone(dt.timezone.utc)
    return F.timestamp_micros(F.lit(int(round(moment.timestamp() * 1_000_000))))


def parse_mixed_ts(column) -> Column:
    """Parse text with or without fraction, zone, and with ``T`` or a space."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    # Accepted layouts, the most specific first.
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    ]
    return F.coalesce(
        text.try_cast("timestamp"),
        *[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts],
    )


def epoch_bucket(column, step_micros: int) -> Column:
    """Start (in epoch microseconds) of the epoch-aligned bucket a timestamp is in."""
    micros = F.unix_micros(F.col(column) if isinstance(column, str) else column)
    return micros - F.pmod(micros, F.lit(step_micros))


def _first_of_month(ts: Column) -> Column:
    return F.day(ts) == 1


def _last_of_month(ts: Column) -> Column:
    return F.to_date(ts) == F.last_day(ts)


def _leap(ts: Column) -> Column:
    year = F.year(ts)
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def date_part(ts: Column, part: str, zone: str = "UTC") -> Column:
    """One calendar attribute of a timestamp; week days count from Monday = 0."""
    table = {
        "asm8": lambda: F.unix_micros(ts) * 1000,
        "year": lambda: F.year(ts),
        "quarter": lambda: F.quarter(ts),
        "month": lambda: F.month(ts),
        "week": lambda: F.weekofyear(ts),
        "weekofyear": lambda: F.weekofyear(ts),
        "day": lambda: F.day(ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts),
        "day_of_week": lambda: F.weekday(ts),
        "dayofweek": lambda: F.weekday(ts),
        "day_of_year": lambda: F.dayofyear(ts),
        "dayofyear": lambda: F.dayofyear(ts),
        "days_in_month": lambda: F.day(F.last_day(ts)),
        "daysinmonth": lambda: F.day(F.last_day(ts)),
        "is_leap_year": lambda: _leap(ts),
        "is_month_start": lambda: _first_of_month(ts),
        "is_month_end": lambda: _last_of_month(ts),
        "is_quarter_start": lambda: _first_of_month(ts) & (F.month(ts) % 3 == 1),
        "is_quarter_end": lambda: _last_of_month(ts) & (F.month(ts) % 3 == 0),
        "is_year_start": lambda: F.dayofyear(ts) == 1,
        "is_year_end": lambda: (F.month(ts) == 12) & (F.day(ts) == 31),
        "tz": lambda: F.lit(zone),
    }
    if part == "freqstr":
        raise SpecError("freqstr describes a whole index, not a column value")
    if part not in table:
        raise SpecError(f"unknown date part {part!r}")
    return table[part]()


def with_date_parts(df: DataFrame, ts: str, parts: list[str]) -> DataFrame:
    """Add ``{ts}_{part}`` for every requested part."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    return df.withColumns({f"{ts}_{p}": date_part(F.col(ts), p, zone) for p in parts})
