"""Rational time: columns of units at a scale of units per second. All results are exact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROUNDINGS = ("truncate", "floor", "ceil", "nearest")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def rescale(units: Column, scale: Column, target: Column, rounding: str = "truncate") -> Column:
    """Units at another scale, as bigint; null where either scale is 0, as an error row is.

    `nearest` rounds halves away from zero. A result beyond 64 bits raises under ANSI.
    """
    if rounding not in ROUNDINGS:
        raise ValueError(f"rounding is one of {ROUNDINGS}")
    product = _wide(units.cast("decimal(20,0)") * target.cast("decimal(18,0)"))
    good = (scale != 0) & (target != 0)
    by = F.when(good, _wide(scale))
    quotient, rest = _div(product, by), product % by
    step = {
        "truncate": F.lit(0),
        "floor": F.when(rest < 0, -1).otherwise(0),
        "ceil": F.when(rest > 0, 1).otherwise(0),
        "nearest": F.when(F.abs(rest) * 2 >= by, F.when(rest < 0, -1).otherwise(1)).otherwise(0),
    }[rounding]
    return F.when(good, (quotient + step).cast("bigint"))


def _div(a: Column, b: Column) -> Column:
    """Division that truncates towards zero, exact for 38 digits."""
    return _wide((a - a % b) / b)


def to_millis(units: Column, scale: Column) -> Column:
    """Truncated milliseconds; 0 where the scale is 0."""
    return F.coalesce(rescale(units, scale, F.lit(1000)), F.lit(0))


def rescale_half_up(units: Column, scale: Column, target: Column) -> Column:
    """Nearest, halves up, for units >= 0; 0 where the scale is 0."""
    n = units.cast("decimal(20,0)") * target.cast("decimal(18,0)")
    by = F.when(scale != 0, scale.cast("decimal(20,0)"))
    return F.coalesce(_div(_wide(n) + _div(_wide(by), F.lit(2)), _wide(by)).cast("bigint"), F.lit(0))


def minus(a: Column, b: Column) -> Column:
    """Difference of unsigned numbers: 0 where it would be negative, null where one is null."""
    return F.when(a >= b, a - b).when(a < b, 0)


def matroska_millis(ticks: Column, scale_ns: Column) -> Column:
    """Milliseconds of a tick count at nanoseconds a tick; 0 where negative."""
    return F.when(ticks > 0, _div(_wide(ticks.cast("decimal(20,0)") * scale_ns.cast("decimal(18,0)")), F.lit(1_000_000).cast("decimal(38,0)")).cast("bigint")).otherwise(0)


def _int_div(a: Column, by: int) -> Column:
    """Floor of a bigint over a positive number, in integers."""
    a = a.cast("bigint")
    return ((a - F.pmod(a, F.lit(by))) / by).cast("bigint")


def _clock_parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    return _int_div(ms, 3_600_000), _int_div(ms, 60_000) % 60, _int_div(ms, 1000) % 60, ms % 1000


def clock(ms: Column, mark: str = ".") -> Column:
    """hh:mm:ss.mmm, with hours of two digits or more."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *_clock_parts(ms))


def ass_clock(ms: Column) -> Column:
    """h:mm:ss.cc with centiseconds truncated."""
    h, m, s, rest = _clock_parts(ms)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, _int_div(rest, 10))


def scc_frame(stamp: Column) -> Column:
    """Frames of a `hh:mm:ss;ff` drop-frame or `hh:mm:ss:ff` label at 30 frames a second; null where invalid.

    A drop-frame label counts 1,800 - 2 frames a minute, but for every tenth minute; frames 0 and 1
    of the minutes that drop them do not exist.
    """
    ok = F.regexp_like(stamp, F.lit(r"^\d{2}:\d{2}:\d{2}[:;]\d{2}$"))
    part = lambda k: F.when(ok, F.substring(stamp, k, 2).cast("bigint"))
    h, m, s, f = part(1), part(4), part(7), part(10)
    drop = F.substring(stamp, 9, 1) == ";"
    minutes = h * 60 + m
    tens = (minutes - minutes % 10) / 10
    frames = ((minutes * 60 + s) * 30 + f) - F.when(drop, 2 * (minutes - tens.cast("bigint"))).otherwise(0)
    bad = (m > 59) | (s > 59) | (f > 29) | (drop & (s == 0) & (f < 2) & (m % 10 != 0))
    return F.when(ok & ~bad, frames.cast("bigint"))


def frames_to_millis(frames: Column) -> Column:
    """At 30000/1001 frames a second, rounded to the nearest."""
    return _int_div(frames * 1001 + 15, 30)


def stamp_millis(value: Column) -> Column:
    """[h:]m:s with a comma or point: seconds under 60, minutes under 60 if hours are given, at most 30 days; else null."""
    shape = r"^(?:\+?(\d+):)?\+?(\d+):\+?(\d*[.,]?\d*(?:[eE][+-]?\d+)?)$"
    parts = F.when(F.regexp_like(value, F.lit(shape)), F.split(F.regexp_replace(value, shape, "$1|$2|$3"), r"\|"))

    def total(p: Column) -> Column:
        hours, minutes = F.nullif(p[0], F.lit("")).cast("bigint"), p[1].cast("bigint")
        seconds = F.replace(p[2], F.lit(","), F.lit(".")).try_cast("double")
        ms = F.coalesce(hours, F.lit(0)) * 3_600_000 + minutes * 60_000 + F.round(seconds * 1000).cast("bigint")
        return F.when((seconds >= 0) & (seconds < 60) & (hours.isNull() | (minutes < 60)) & (ms <= 30 * 24 * 3_600_000), ms)

    return _bound(parts, total)


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def ttml_millis(value: Column, frames: float = 30.0, ticks: float = 1.0, most: float | None = 2_592_000_000.0) -> Column:
    """Clock times, with frames as a fourth part, and offsets with a unit of ms, h, m, s, f or t; rounded half away from zero.

    Offsets beyond `most` milliseconds, 30 days, are null; None bounds them by 64 bits only.
    """
    v = F.trim(value)
    four = F.regexp_like(v, F.lit(r"^[^:]*:[^:]*:[^:]*:[^:]*$"))
    base, rest = stamp_millis(F.regexp_extract(v, r"^(.*):[^:]*$", 1)), F.regexp_extract(v, r":([^:]*)$", 1).try_cast("double")
    framed = F.when((rest >= 0) & (rest < F.ceil(F.lit(frames))), base + F.round(rest / frames * 1000).cast("bigint"))
    unit = F.regexp_extract(v, r"(ms|h|m|s|f|t)$", 1)
    number = F.regexp_extract(v, r"^(.*?)(?:ms|h|m|s|f|t)$", 1).try_cast("double")
    #: Milliseconds of each unit.
    scale = F.when(unit == "ms", 1.0).when(unit == "h", 3_600_000.0).when(unit == "m", 60_000.0).when(unit == "s", 1000.0).when(unit == "f", 1000.0 / frames).otherwise(1000.0 / ticks)
    bound = float(2**63 - 1024) if most is None else most
    offset = F.when((unit != "") & (number * scale >= 0) & (number * scale <= bound), F.round(number * scale).cast("bigint"))
    return F.when(four, framed).when(F.contains(v, F.lit(":")), stamp_millis(v)).otherwise(offset)


def fixed_point(value: Column) -> Column:
    """Whole part of a 16.16 number."""
    return F.shiftright(value, 16)


def sample_delta(a: Column, b: Column) -> Column:
    """How far two sample counts are apart."""
    return F.abs(a - b)


def decode_window(start: Column, end: Column, rate: Column) -> tuple[Column, Column]:
    """What an audio decoder reads for a window: 34 frames of 1,024 samples and 250 ms before, four frames after; rates of 8 to 48 kHz."""
    r = F.least(F.greatest(rate, F.lit(8_000)), F.lit(48_000)).cast("bigint")
    ceil = lambda n: ((F.lit(n) + r - 1 - (F.lit(n) + r - 1) % r) / r).cast("bigint")
    return minus(start, ceil(34 * 1024 * 1000) + 250), end + ceil(4 * 1024 * 1000)
