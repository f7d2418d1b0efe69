"""Column functions on numbers: safe arithmetic, coercion, boxes, and the deterministic uniform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den; 0 unless den is positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def to_weight(c: Column) -> Column:
    """A weight from text: missing or bad is 1, negative is 0."""
    return F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(1.0)))


def to_enabled(c: Column) -> Column:
    """A flag from text: missing is true; 0, false, no, off and blank are not."""
    return F.coalesce(~F.lower(F.trim(c)).isin("0", "false", "no", "off", ""), F.lit(True))


def to_percent(c: Column, default: float) -> Column:
    return clamp(F.coalesce(c.try_cast("double"), F.lit(default)), 0.0, 100.0)


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: str, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    parts = ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496)"


def entropy_bits(p: Column) -> Column:
    """An aggregate: entropy of shares that sum to 1."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def padded(c: Column, width: int = 6) -> Column:
    """An id as text, with zeros before it up to the width; longer ones are whole."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def parts_per_million(num: Column, den: int) -> Column:
    """num / den of whole numbers from 0 on, rounded half up to six places without an error of floating point."""
    n = num.cast("long") * 2_000_000 + den
    return (n - n % (2 * den)).cast("double") / (2 * den) / 1_000_000


def inside_page(x: Column, y: Column, w: Column, h: Column, width, height) -> Column:
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x < width) & (y < height) & (x + w <= width) & (y + h <= height)


def overlap(a: tuple, b: tuple) -> Column:
    """Area that two boxes (x, y, w, h) share; sides count as one pixel at least."""
    one = F.lit(1)
    across = F.least(a[0] + F.greatest(a[2], one), b[0] + F.greatest(b[2], one)) - F.greatest(a[0], b[0])
    down = F.least(a[1] + F.greatest(a[3], one), b[1] + F.greatest(b[3], one)) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)
