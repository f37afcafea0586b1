"""Column functions: element-wise algebra, vectors, flags, packed indices and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for a zero divisor, whose sign counts."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    a, b = a.cast("double"), b.cast("double")
    below = b.cast("string").startswith("-")  # only the text tells -0.0
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(b.isNull() | a.isNull(), F.lit(None)).when(F.isnan(a) | (a == 0), nan).when((a > 0) != below, inf).otherwise(-inf)


def rounded(c: Column, places: int) -> Column:
    """Rounded as SQL engines on doubles do: the product with a power of ten goes to the nearest whole number, halves away from zero; what overflows stays.

    Spark's own rounding takes the shortest decimal text of a double, so 0.285 becomes 0.29, where 0.285 * 100 lies below 28.5.
    """
    power = F.lit(float(10**places))
    # the sign is put back, so that of a zero stays
    out = F.signum(c) * (F.round(F.abs(c * power), 0) / power)
    return F.when(F.abs(c * power) < F.lit(float("inf")), out).otherwise(c)


def same(a: Column, b: Column) -> Column:
    """Equality under which NaN equals nothing."""
    return (a == b) & ~F.isnan(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_angle(a: Column, b: Column) -> Column:
    """Degrees between two arrays, by the clamped arc cosine."""
    c = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def angle3(a: Column, b: Column) -> Column:
    """Degrees between vectors of three, by the arc tangent of |a x b| over a . b."""
    return F.degrees(F.atan2(norm(cross(a, b)), dot(a, b)))


def equal_division(x: Column, most: int) -> Column:
    """Least n >= ceil(x / most) that divides x."""
    least = F.ceil(x / F.lit(most)).cast("long")
    return F.filter(F.sequence(least, x), lambda n: x % n == 0)[0]


def flags_encode(text: Column, names: list[str], sep: str = "|") -> Column:
    """Array of 0 and 1 by name; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\|" if sep == "|" else sep)
    return F.array(*[F.array_contains(parts, n).cast("int") for n in names])


def flags_decode(hot: Column, names: list[str], sep: str = "|") -> Column:
    """Names whose flag is set, in order of the list."""
    return F.array_join(F.array_compact(F.array(*[F.when(hot[i] != 0, F.lit(n)) for i, n in enumerate(names)])), sep)


def capitalize_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def triangle_to_index(row: Column, col: Column) -> Column:
    """Position of (row, col), row >= col, in a packed lower triangle; all from 0."""
    return (row * (row + 1) / 2).cast("long") + col


def index_to_triangle(i: Column) -> tuple[Column, Column]:
    """(row, col) of a packed position; the root is corrected by one for rounding."""
    guess = F.floor((F.sqrt(8.0 * i.cast("double") + 1.0) - 1.0) / 2.0).cast("long")
    tri = lambda r: (r * (r + 1) / 2).cast("long")
    row = F.when(tri(guess) > i, guess - 1).when(tri(guess + 1) <= i, guess + 1).otherwise(guess)
    return row, i - tri(row)


def viewport(gaze: Column, height: float, width: float) -> Column:
    """Gaze vector to screen position in [0, 1]; angles of the field of view in radians."""
    from math import tan

    return F.array(gaze[0] / gaze[2] / F.lit(tan(width / 2)) / 2 + 0.5, gaze[1] / gaze[2] / F.lit(tan(height / 2)) / 2 + 0.5)


def gaze(view: Column, height: float, width: float) -> Column:
    """Screen position to a unit gaze vector."""
    from math import tan

    x, y = (view[0] - 0.5) * 2 * F.lit(tan(width / 2)), (view[1] - 0.5) * 2 * F.lit(tan(height / 2))
    n = F.sqrt(x * x + y * y + 1.0)
    return F.array(x / n, y / n, 1.0 / n)


def natural_key(s: Column, digits: int = 12) -> Column:
    """Sort key under which x2 comes before x10: numbers padded, letters in lower case.

    Longer numbers than ``digits`` keep their length and sort after the padded ones.
    """
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < digits), F.lpad(p, digits, "0")).otherwise(p)), "")


def clock_text(micros: Column) -> Column:
    """HH:MM:SS,mmm of a time in microseconds; hours take as many digits as they need."""
    total = F.floor(micros / F.lit(1000)).cast("long")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    hours = F.floor(total / 3600000).cast("long")
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(total / 60000) % 60), F.lit(":"), two(F.floor(total / 1000) % 60), F.lit(","), F.lpad((total % 1000).cast("string"), 3, "0"))


def raised_cosine(t: Column, centre: Column, width: float) -> Column:
    """(cos(d) + 1) / 2 where |d| < pi, d = (t - centre) pi / (2 width)."""
    d = (t - centre) * F.lit(3.141592653589793) / F.lit(2 * width)
    return F.when(F.abs(d) < 3.141592653589793, (F.cos(d) + 1) / 2).otherwise(0.0)


def piecewise_rate(u: Column) -> Column:
    """exp(u) below 0, 1 + u + u * u / 2 from 0 on."""
    return F.when(u < 0, F.exp(u)).otherwise(1 + u + u * u / 2)


def piecewise_rate_slope(u: Column) -> Column:
    return F.when(u < 0, F.exp(u)).otherwise(1 + u)


def convert_by_type(kind: Column, value: Column) -> dict[str, Column]:
    """Typed readings of a logged value by its type name, with or without its namespace; null where it is another type or can't be read."""
    kind = F.regexp_replace(kind, r"^(System|UnityEngine)\.", "")
    whole = kind.isin("SByte", "Byte", "Int16", "Int32", "Int64", "UInt16", "UInt32", "UInt64")
    real = kind.isin("Single", "Double")
    return {
        "as_long": F.when(whole, value.try_cast("long")),
        "as_double": F.when(real | whole, value.try_cast("double")),
        "as_boolean": F.when(kind == "Boolean", F.lower(value) == "true"),
        "as_array": F.when(kind.endswith("[]"), F.transform(F.split(value, r"\s*,\s*"), lambda x: x.try_cast("double"))),
        "as_color": F.when(kind == "Color", F.transform(F.regexp_extract_all(value, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))),
    }


def parse_log(line: Column) -> dict[str, Column]:
    """Fields of a log line: ``[ticks] name (type) = value`` or ``[ticks] message``. Dots in names go."""
    full = r"^\[(\d+)\] ([\w.]+) \(?(.*?)\)? ?= ([^\r\n]*)$"
    typed = line.rlike(full)
    part = lambda i: F.when(typed, F.regexp_extract(line, full, i))
    return {
        "ticks": F.nullif(F.regexp_extract(line, r"^\[(\d+)\]", 1), F.lit("")).cast("long"),
        "name": F.regexp_replace(part(2), r"\.", ""),
        "type": part(3),
        "value": part(4),
        "message": F.when(~typed, F.regexp_extract(line, r"^\[\d+\] (.*)$", 1)),
    }


def decode_enum(value: Column, names: dict[int, str]) -> Column:
    """Name of an integer; an unknown one is an error."""
    pairs = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.when(value.isNull(), None).otherwise(F.coalesce(pairs[value], F.raise_error(F.concat(F.lit("unknown value "), value.cast("string")))))


def decode_bits(value: Column, names: dict[int, str], sep: str = "_") -> Column:
    """Names of the bits set, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(value.bitwiseAND(F.lit(k)) != 0, F.lit(v)) for k, v in sorted(names.items())])), sep)


def encode_bits(text: Column, names: dict[int, str], sep: str = "_") -> Column:
    parts = F.split(text, sep)
    out = F.lit(0)
    for k, v in names.items():
        out = out.bitwiseOR(F.when(F.array_contains(parts, v), F.lit(k)).otherwise(F.lit(0)))
    return out
