"""Column expressions shared by the operators: dates, tokens, vectors and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tokenizer: separators, stripped characters, words of no content.
SEPARATORS = r"[ \-/:]"
STRIPPED = r'[(*"./)]'


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def month_ordinal(d: Column, base_year: int) -> Column:
    return (F.year(d) - base_year) * 12 + F.month(d) - 1


def month_start(m: Column, base_year: int) -> Column:
    return F.make_date((F.floor(m / 12) + base_year).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))


def date_text(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def order_statistic(values: Column, q: float) -> Column:
    """The value at place ``max(0, int(n q) - 1)`` of the sorted values; null if there is none."""
    s = F.array_sort(values)
    return F.get(s, F.greatest(F.lit(0), F.floor(F.size(s) * q).cast("int") - 1))


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    parts = F.transform(F.split(c, SEPARATORS), lambda x: F.regexp_replace(x, STRIPPED, ""))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*stop) if stop else x != "")


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normal_component(v: list[Column], axis: list[Column]) -> list[Column]:
    """What is left of ``v`` without its projection on ``axis``."""
    k = F.coalesce(F.try_divide(dot(v, axis), dot(axis, axis)), F.lit(0.0))
    return [p - k * q for p, q in zip(v, axis, strict=True)]


def vector(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def first_token(c: Column, fixes: dict[str, str] | None = None) -> Column:
    """Text before the first blank, some of them replaced."""
    token = F.split(c, " ")[0]
    return reduce(lambda acc, kv: F.when(token == kv[0], kv[1]).otherwise(acc), (fixes or {}).items(), token)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def discretised(y: Column, low: float = 1, high: float = 19) -> Column:
    """0 below ``low``, 2 from ``high`` on, else 1."""
    return F.when(y < low, 0).when(y >= high, 2).otherwise(1)


def box_area(south: Column, north: Column, west: Column, east: Column, radius: float = 6371.0) -> Column:
    """Area of a latitude and longitude box, as width at its middle times height along a meridian, in square units of ``radius``."""
    height = F.radians(north - south) * radius
    half = F.sin(F.radians(east - west) / 2) * F.cos(F.radians((north + south) / 2))
    return height * 2 * radius * F.asin(half)
