"""Colour conversions and tests as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB gamma, the sRGB to XYZ matrix and the D65 white point, in the precision that results depend on.
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.204, 1.057))
WHITE = (0.95047, 1.0, 1.08883)


def d(value: float) -> Column:
    return F.lit(float(value))


def lab(r, g, b) -> tuple[Column, Column, Column]:
    """L, a and b (double) of columns with channels from 0 to 255."""
    linear = []
    for c in (r, g, b):
        v = F.col(c).cast("double") / 255.0
        linear.append(F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, d(2.4))).otherwise(v / 12.92))
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = (linear[0] * row[0] + linear[1] * row[1] + linear[2] * row[2]) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + d(16) / 116.0))
    return 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])


def round_half_up(v: Column) -> Column:
    return F.floor(v + d(0.5))


def clamp255(v: Column) -> Column:
    return F.greatest(F.least(round_half_up(v), F.lit(255)), F.lit(0))


def hex2(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 2, "0"))


def hex_of_lab(l, a, b) -> Column:
    """#rrggbb of Lab columns, channels rounded half up and clamped."""
    l, a, b = (F.col(c) if isinstance(c, str) else c for c in (l, a, b))
    fy = (l + 16.0) / 116.0
    xyz = []
    for f, white in ((fy + a / 500.0, WHITE[0]), (fy, WHITE[1]), (fy - b / 200.0, WHITE[2])):
        cube = f * f * f
        xyz.append(F.when(cube > 0.008856, cube).otherwise((f - d(16) / 116.0) / 7.787) * white)
    out = [F.lit("#")]
    for row in TO_RGB:
        c = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        gamma = F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, d(0)), d(1) / 2.4) - 0.055).otherwise(12.92 * c)
        out.append(hex2(clamp255(gamma * 255.0)))
    return F.concat(*out)


def saturation(r="r", g="g", b="b") -> Column:
    """(max - min) / max of the channels, 0 for black."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == 0, d(0)).otherwise((high - low) / high.cast("double"))


def near_white(l: Column, chroma: Column) -> Column:
    return (l > 62) & (chroma < 24)


def near_black(l: Column, chroma: Column) -> Column:
    return (l < 38) & (chroma < 22)
