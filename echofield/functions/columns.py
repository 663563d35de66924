"""Column expressions for points, angles, registers, clocks and display. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(value: float) -> Column:
    return F.lit(float(value))


def finite(*columns: Column) -> Column:
    """Not null, not NaN and not infinite, all of them."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < d(math.inf)), F.lit(False))
    return out


def within(c: Column, bounds: tuple[float, float]) -> Column:
    """Both ends included; NaN, which Spark sorts above all numbers, is outside."""
    return (c >= d(bounds[0])) & (c <= d(bounds[1])) & ~F.isnan(c)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def norm(*columns: Column) -> Column:
    total = columns[0] * columns[0]
    for c in columns[1:]:
        total = total + c * c
    return F.sqrt(total)


def cell(c: Column, leaf: float) -> Column:
    """The voxel a coordinate falls into."""
    return F.floor(c / d(leaf))


def azimuth_centideg(x: Column, y: Column) -> Column:
    """0 .. 35999, counter-clockwise from +x."""
    return F.pmod(F.floor(F.degrees(F.atan2(y, x)) * 100).cast("int"), F.lit(36000))


def in_sector(azimuth: Column, low: int, high: int) -> Column:
    """A sector whose low end is above its high end runs through north; equal ends hold nothing."""
    if low < high:
        return (azimuth >= low) & (azimuth <= high)
    return ((azimuth >= low) | (azimuth <= high)) if low > high else F.lit(False)


def euler_matrix(yaw: float, pitch: float, roll: float) -> list[list[float]]:
    """Rotation by roll about x, then pitch about y, then yaw about z."""
    cy, sy, cp, sp, cr, sr = (f(a) for a in (yaw, pitch, roll) for f in (math.cos, math.sin))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def compose(outer: tuple, inner: tuple) -> tuple[list[list[float]], list[float]]:
    """The transform that applies inner, then outer; each is a 3x3 matrix and an offset."""
    (a, t), (b, u) = outer, inner
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)], [sum(a[i][k] * u[k] for k in range(3)) + t[i] for i in range(3)]


def quaternion_rows(qx: Column, qy: Column, qz: Column, qw: Column) -> tuple[Column, list[list[Column]]]:
    """Whether the quaternion has a length, and the rows of its rotation matrix."""
    n = norm(qx, qy, qz, qw)
    x, y, z, w = (q / n for q in (qx, qy, qz, qw))
    two = d(2)
    return n > d(1e-12), [
        [d(1) - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w)],
        [two * (x * y + z * w), d(1) - two * (x * x + z * z), two * (y * z - x * w)],
        [two * (x * z - y * w), two * (y * z + x * w), d(1) - two * (x * x + y * y)],
    ]


def signed16(raw: Column) -> Column:
    return F.when(raw >= 32768, raw - 65536).otherwise(raw)


def scaled_register(raw: Column, scale: Column, is_signed: Column) -> Column:
    """A 16-bit register as a number; one that was not read counts as 0."""
    return F.coalesce(F.when(is_signed, signed16(raw)).otherwise(raw).cast("double") * scale, d(0))


def near_hour(nominal_s: Column, stamp_s: Column) -> Column:
    """Moves a stamp by an hour where it is over half an hour from the nominal time."""
    return F.when(nominal_s - stamp_s > 1800, stamp_s + 3600).when(stamp_s - nominal_s > 1800, stamp_s - 3600).otherwise(stamp_s)


def hour_plus_micros(gps_s: Column, micros_past: Column) -> Column:
    """Nanoseconds: the hour of a GPS stamp, and microseconds past it."""
    return (gps_s - F.pmod(gps_s, F.lit(3600))) * 1_000_000_000 + micros_past * 1000


def calendar_hour(year: Column, month: Column, day: Column, hour: Column, valid: Column) -> Column:
    """Seconds since 1970 at the hour of a calendar stamp, 0 where its magic is missing. Years count from 2000."""
    at = F.unix_date(F.make_date(F.lit(2000) + year, month, day)).cast("long") * 86400 + hour * 3600
    return F.when(valid, F.coalesce(at, F.lit(0))).otherwise(F.lit(0)).cast("long")


def to_u8(c: Column) -> Column:
    return F.when(finite(c), F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(255)).cast("int")).otherwise(0)


def class_id(intensity: Column, threshold: float = 180.0, stable: bool = False) -> Column:
    """3 for a reflector, else 1 in the stable map and 2 in the current cloud."""
    return F.when(intensity >= d(threshold), 3).otherwise(1 if stable else 2)


def _ramp(value: Column) -> Column:
    t = F.greatest(d(0), F.least(d(1), value))
    first, second, third = t / d(0.33), (t - d(0.33)) / d(0.33), (t - d(0.66)) / d(0.34)
    # End colours of the distance ramp's three parts.
    return (
        F.when(t < d(0.33), F.array(d(0.05), d(0.25) + d(0.65) * first, d(1.0) - d(0.55) * first))
        .when(t < d(0.66), F.array(d(0.05) + d(0.85) * second, d(0.9), d(0.45) - d(0.35) * second))
        .otherwise(F.array(d(0.9) + d(0.1) * third, d(0.9) - d(0.75) * third, d(0.1)))
    )


def colour(mode: str, x: Column, y: Column, z: Column, intensity: Column, lidar: Column, cls: Column, cloud_type: Column, reflectors: bool = True) -> Column:
    """Red, green and blue of a point, 0 to 1."""
    grey, gold, green = F.array(d(0.55), d(0.55), d(0.55)), F.array(d(1.0), d(0.86), d(0.1)), F.array(d(0.1), d(1.0), d(0.35))
    if mode == "height":
        t = F.greatest(d(0), F.least(d(1), (z + d(2)) / d(5)))
        low, high = t * d(2), (t - d(0.5)) * d(2)
        plain = F.when(t < d(0.5), F.array(d(0.05), d(0.2) + d(0.65) * low, d(1.0) - d(0.75) * low)).otherwise(F.array(d(0.1) + d(0.9) * high, d(0.85) - d(0.55) * high, d(0.1)))
    elif mode == "intensity":
        t = F.greatest(d(0), F.least(d(1), intensity / d(255)))
        plain = F.array(d(0.12) + d(0.88) * t, d(0.12) + d(0.78) * t, d(0.12) + d(0.2) * t)
    elif mode in ("x-distance", "y-distance", "z-distance"):
        c, reach = {"x": (x, 100.0), "y": (y, 8.0), "z": (z, 5.0)}[mode[0]]
        plain = _ramp(F.abs(c) / d(reach))
    elif mode == "lidar_id":
        plain = F.when(lidar == 0, F.array(d(0.15), d(0.45), d(1.0))).when(lidar == 1, F.array(d(0.15), d(0.95), d(0.45))).when(lidar == 2, F.array(d(0.75), d(0.35), d(1.0))).otherwise(grey)
    elif mode == "stable-temporary":
        plain = F.when(cloud_type == 2, F.array(d(0.2), d(0.62), d(1.0))).otherwise(F.array(d(0.78), d(0.8), d(0.76)))
    else:
        plain = grey
    if not reflectors:
        return plain
    if mode == "reflector":
        return F.when(cls == 3, green).when(intensity >= d(180), gold).otherwise(plain)
    return F.when(cls == 3, gold).otherwise(plain)


def shown(c: Column, decimals: int) -> Column:
    """A number for display, `---` where there is none."""
    return F.when(finite(c), F.format_string(f"%.{decimals}f", c)).otherwise("---")


def axis_at_height(point: tuple[Column, ...], axis: tuple[Column, ...], z: Column) -> tuple[Column, Column, Column]:
    """Where an axis (a point and a direction of any length) passes a height; null where it runs along it."""
    length = norm(*axis)
    unit = [a / length for a in axis]
    t = F.when(F.abs(unit[2]) >= d(1e-9), (z - point[2]) / unit[2])
    return tuple(p + t * u for p, u in zip(point, unit))


def radial_residual(at: tuple[Column, ...], point: tuple[Column, ...], axis: tuple[Column, ...], radius: Column) -> Column:
    """How far a place lies outside a cylinder's surface; negative inside."""
    length = norm(*axis)
    unit, gap = [a / length for a in axis], [x - p for x, p in zip(at, point)]
    along = gap[0] * unit[0] + gap[1] * unit[1] + gap[2] * unit[2]
    return norm(*[g - along * u for g, u in zip(gap, unit)]) - radius


def displacement(cx: Column, cy: Column, rms: Column, zero: tuple[float, float]) -> dict[str, Column]:
    """How far a centre is from the zero position, and the covariance that its residual stands for."""
    return {"dx": d(zero[0]) - cx, "dy": d(zero[1]) - cy, "covariance_xx": rms * rms, "covariance_xy": d(0), "covariance_yy": rms * rms}
