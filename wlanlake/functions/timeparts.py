"""Time stamps, named zones and bucket keys."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.util import col_of, strip


def check_zone(name: str) -> str:
    """Refuse an unknown zone instead of quietly answering in UTC."""
    try:
        ZoneInfo(str(name))
    except Exception as exc:
        raise ValueError(f"unknown time zone {name!r}; use an IANA name such as Asia/Riyadh") from exc
    return str(name)


def as_of_utc(as_of) -> datetime:
    """The moment a query looks back from, as naive UTC."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def ts_lit(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def since(as_of, *, days: int | None = None, minutes: int | None = None) -> Column | None:
    """Lower bound of a look-back, or None for all time."""
    if days is not None:
        if not 1 <= int(days) <= spec.MAX_DAYS:
            raise ValueError(f"days must be 1..{spec.MAX_DAYS}")
        return ts_lit(as_of_utc(as_of) - timedelta(days=int(days)))
    if minutes:
        return ts_lit(as_of_utc(as_of) - timedelta(minutes=int(minutes)))
    return None


def local_time(ts, zone: str) -> Column:
    """Wall clock of a stored UTC instant in a named zone."""
    return F.from_utc_timestamp(col_of(ts), check_zone(zone))


def day_index(local: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(local) - 1


def day_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in spec.DAYS_SUN_FIRST]), index)


def bucket_key(local: Column, bucket: str) -> Column:
    """Text of the wall-clock hour or day; rows and spine share it, so they cannot disagree."""
    return F.date_format(local, "yyyy-MM-dd" if bucket == "day" else "yyyy-MM-dd'T'HH")


def api_time(c) -> Column:
    """Instant of a time given as text: ISO or blank-separated, zone-less means UTC.

    A bare number is epoch seconds below 1e10 and milliseconds from there on.
    """
    s = strip(c)
    number = F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    millis = F.when(number < 1e10, number * 1000).otherwise(number).cast("long")
    zoned = F.lower(s).rlike(r"(z|[+-][0-9]{2}:?[0-9]{2})$")
    stamped = F.when(zoned, s).otherwise(F.concat(F.replace(s, F.lit(" "), F.lit("T")), F.lit("Z")))
    return F.when(number.isNotNull(), F.timestamp_millis(millis)).when(
        s != "", stamped.try_cast("timestamp")
    )
