"""Null-safe numeric expressions; NaN counts as null, angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """A double, null where the value is no finite number."""
    d = c.try_cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def row_mean(a: Column, b: Column) -> Column:
    """Mean of what is not null."""
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def clamp01(c: Column) -> Column:
    return F.when(c < 0, 0.0).when(c > 1, 1.0).otherwise(c)


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding of ties to the even neighbour."""
    return F.bround(c, digits)


def angle(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """The angle at ``b``; null for missing points and for sides of length zero."""
    ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
    n = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.try_divide(ux * vx + uy * vy, n)
    return F.when(n > 0, F.degrees(F.acos(F.when(cosine > 1, 1.0).when(cosine < -1, -1.0).otherwise(cosine))))


def line_angle(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The direction from ``a`` to ``b``; null for a line of length zero."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx)))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two directions."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, F.nullif(std, F.lit(0.0)))


def timestamp_ms(frame: Column, fps: Column) -> Column:
    """Milliseconds from the start; the frame number itself where the rate is not positive. A negative frame is an error."""
    frame = F.when(frame < 0, F.raise_error(F.lit("a frame number must not be negative")).cast("long")).otherwise(frame)
    return F.when(fps > 0, F.bround(F.try_divide(frame.cast("double"), fps) * 1000)).otherwise(frame).cast("long")


def slow_fps(fps: Column, factor: Column) -> Column:
    """Rate of a slowed clip: at least 1, from 24 where the rate is unknown."""
    return F.greatest(F.try_divide(F.when(fps > 0, fps).otherwise(24.0), factor), F.lit(1.0))


def duration_sec(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.try_divide(frames.cast("double"), fps)).otherwise(0.0)


def fourcc(code: Column) -> Column:
    """The four characters of a codec number, lowest byte first."""
    return F.concat(*[F.chr(F.shiftright(code, 8 * i).bitwiseAND(F.lit(255)).cast("long")) for i in range(4)])


def bat_angle(p: Column) -> Column:
    """Bat angle of the drawn sample clip, piecewise linear in its progress."""
    return F.when(p < 0.25, -130 + 25 * (p / 0.25)).when(p < 0.55, -105 + 150 * ((p - 0.25) / 0.30)).when(p < 0.80, 45 + 45 * ((p - 0.55) / 0.25)).otherwise(90 - 18 * ((p - 0.80) / 0.20))


def drawn_phase(p: Column) -> Column:
    """Phase of the drawn sample clip by its progress."""
    return F.when(p < 0.18, "stance").when(p < 0.35, "backlift").when(p < 0.55, "downswing").when(p < 0.62, "contact_zone").when(p < 0.85, "follow_through").otherwise("recovery")
