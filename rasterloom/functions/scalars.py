"""Random draws, names, sizes, thresholds and path text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import d, round_half_up

EXTENSIONS, MIMES = ("png", "jpg", "jpeg", "webp"), ("image/png", "image/jpeg", "image/webp")
_M32 = 0xFFFFFFFF


def _imul(x: Column, y: Column) -> Column:
    low = x * y.bitwiseAND(F.lit(65535))
    high = (x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(65535)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(_M32))


def draw(seed: Column, i: Column) -> Column:
    """Draw i (from 0) of the 32-bit generator seeded with seed, in [0, 1); any draw directly, without those before it."""
    # The generator's increment and its odd masks.
    a = (seed.cast("long") + (i.cast("long") + 1) * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_M32))
    t = _imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    u = _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    t = t.bitwiseXOR((t + u).bitwiseAND(F.lit(_M32)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / 4294967296.0


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def supported(name: Column, mime: Column) -> Column:
    return extension(name).isin(*EXTENSIONS) & (mime.isin(*MIMES) | (mime == ""))


def vector_name(name: Column, tail: str = "_vector.svg") -> Column:
    """The name with its last extension replaced; a leading dot starts no extension."""
    return F.concat(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"), F.lit(tail))


def file_size(size: Column) -> Column:
    kb, mb = size / d(1024), size / d(1048576)
    # Half up on the decimal text of a double, as fixed-point output rounds.
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, F.concat(F.format_string("%.1f", kb), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", mb), F.lit(" MB")))
    )


def error_message(name: Column, message: Column) -> Column:
    """A reader's message for an error of a class and text."""
    # The messages.
    return (
        F.when(name == "InvalidStateError", "이미지 파일을 읽을 수 없습니다. 파일이 손상되었을 수 있습니다.")
        .when(F.contains(message, F.lit("OpenCV")), message)
        .when(F.contains(message, F.lit("decode")), "이미지를 디코딩할 수 없습니다. 파일 형식을 확인해주세요.")
        .when(message != "", F.concat(F.lit("변환 중 오류가 발생했습니다: "), message))
        .otherwise("알 수 없는 오류로 변환에 실패했습니다.")
    )


def tolerances(smoothing: Column, diagonal: Column) -> tuple[Column, Column]:
    """Simplification distance and fitting error."""
    epsilon = F.greatest(d(0.6), F.least(F.greatest(smoothing, d(0)), d(100)) / 100.0 * diagonal * 0.004)
    return epsilon, F.greatest(d(0.8), epsilon * 2.2)


def min_area(pixels: Column, ratio: Column) -> Column:
    return F.greatest(d(6), pixels * ratio)


def line_radius(option: Column, height: Column) -> Column:
    return F.coalesce(option, F.greatest(d(2), round_half_up(height * 0.006).cast("double")))


def scale_factor(width: Column, height: Column, mode: Column, longest: int = 2200) -> Column:
    """mode: null for automatic (2 below 1100 pixels, else 1), or a number; the result never passes `longest`."""
    side = F.greatest(width, height).cast("double")
    factor = F.coalesce(mode, F.when(side < 1100, d(2)).otherwise(d(1)))
    return F.when(side * factor > longest, longest / side).otherwise(factor)


def scaled_side(side: Column, width: Column, height: Column, mode: Column) -> Column:
    """A side at working size, rounded half up; within 1 % a picture is left alone."""
    factor = scale_factor(width, height, mode)
    return F.when(F.abs(factor - 1.0) <= 0.01, side).otherwise(F.greatest(F.lit(1), round_half_up(side * factor))).cast("int")


def fixed2(v: Column) -> Column:
    """A number rounded half up to 2 decimals."""
    return F.floor(v * 100.0 + d(0.5)) / 100.0


def number_text(v: Column) -> Column:
    """A double as short text: no trailing .0 and no negative zero."""
    return F.regexp_replace(F.when(v == 0, d(0)).otherwise(v).cast("string"), r"\.0$", "")


def anchors(path: Column) -> Column:
    return sum((F.regexp_count(path, F.lit(rf"{c}\s*-?\d")) for c in "MCL"), F.lit(0))


def polygon_area(points: str) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    n = F.size(points)
    term = lambda i: (
        F.get(points, i).x * F.get(points, (i + 1) % n).y - F.get(points, (i + 1) % n).x * F.get(points, i).y
    )
    return F.when(n == 0, d(0)).otherwise(F.abs(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), d(0), lambda s, i: s + term(i))) / 2.0)


def path_length(points: str, closed: Column) -> Column:
    n = F.size(points)
    last = F.when(closed, n - 1).otherwise(n - 2)
    leg = lambda i: F.hypot(F.get(points, (i + 1) % n).x - F.get(points, i).x, F.get(points, (i + 1) % n).y - F.get(points, i).y)
    return F.when(last < 0, d(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), d(0), lambda s, i: s + leg(i)))
