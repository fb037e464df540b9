"""Numbers, dates and geography."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


def between_or_null(value: Column, low: float, high: float) -> Column:
    """Null outside [low, high]."""
    return F.when(value.between(low, high), value)


def sentinel_or_null(value: Column, sentinels: Sequence) -> Column:
    return F.when(~value.isin(*sentinels), value)


def nan_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clipped(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Into [low, high]; null stays null (least and greatest alone would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def divided(top: Column, bottom: Column) -> Column:
    """Doubles by IEEE rules: over zero a number is infinite and zero is NaN, where Spark's own division raises."""
    zero = F.when(top > 0, float("inf")).when(top < 0, float("-inf")).when(top.isNotNull(), float("nan"))
    return F.when(bottom == 0, F.when(F.isnan(top), top).otherwise(zero)).otherwise(F.try_divide(top, bottom))


def safe_ratio(top: Column, bottom: Column, floor: float) -> Column:
    return top / F.greatest(bottom, F.lit(floor))


def is_usable(value: Column) -> Column:
    """Neither null, NaN, infinite nor zero."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (value != 0), F.lit(False))


def even_rounded(value: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(value, digits)


def looked_up(value: Column, pairs: Mapping, default=None) -> Column:
    """A small literal dimension; a value that it lacks gives `default`."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    found = F.try_element_at(F.create_map(*flat), value) if flat else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def product(values: Sequence[Column]) -> Column:
    """Over columns of a row; null counts as 1."""
    out = F.lit(1.0)
    for v in values:
        out = out * F.coalesce(v, F.lit(1.0))
    return out


def any_of(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def first_largest(columns: Mapping[str, Column]) -> Column:
    """The name of the first column that attains the row's maximum."""
    most = F.greatest(*columns.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(list(columns.items())):
        out = F.when(value == most, name).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; arguments in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def angle(y: Column, x: Column) -> Column:
    """In [0, 2 pi)."""
    a = F.atan2(y, x)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    turn = value * (2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between timestamps."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def in_season(day: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """(month, day) within [first, last]; a season may pass the turn of the year."""
    code = F.month(day) * 100 + F.dayofmonth(day)
    a, b = first[0] * 100 + first[1], last[0] * 100 + last[1]
    return code.between(a, b) if a <= b else (code >= a) | (code <= b)


def nearest_signed_days(day: Column, dates: Sequence[str], cap: int) -> Column:
    """Days from the nearest of the dates (positive after it), the first of equally near ones, within +/- cap."""
    gaps = F.array(*[F.datediff(day, F.lit(d).cast("date")) for d in dates])
    best = F.aggregate(gaps, F.lit(None).cast("int"), lambda a, g: F.when(a.isNull() | (F.abs(g) < F.abs(a)), g).otherwise(a))
    return F.greatest(F.least(best, F.lit(cap)), F.lit(-cap))


def clock(minutes: Column) -> Column:
    """HH:MM of minutes after midnight."""
    whole = F.floor(minutes).cast("long")
    return F.concat(F.lpad((F.floor(whole / 60) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the key's md5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def critical_fractile(under: float, over: float) -> float:
    return under / (under + over)


def grid(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced values from low to high."""
    return [low + (high - low) * k / (n - 1) for k in range(n)]
