"""Column functions on pages, lines and blocks: clamped and warped boxes, metadata, gates, sizes, percent maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, to_percent

#: Densities at 0, 50 and 100 percent.
DENSITY_AT = {"sparse": (0.90, 0.15, 0.05), "normal": (0.10, 0.70, 0.15), "dense": (0.00, 0.15, 0.60), "mixed": (0.00, 0.00, 0.20)}
#: Names of font-size profiles and their range in px; any other name is balanced.
FONT_RANGES = {
    (14, 22): ("readable", "large", "easy"), (7, 13): ("small / hard", "small-hard", "small_hard", "hard", "dense"), (8, 14): ("compact", "small"),
}
BALANCED = (10, 18)
#: Defaults of text, table and latex in a content mix.
MIX = (60.0, 25.0, 15.0)
#: Gray levels of a contrast class; any other class is high.
GRAYS = {"low": (120, 170), "medium": (60, 119), "high": (0, 59)}
#: Line height for a font size of 1, by density and page family.
LEADING = {"dense": 1.15, "sparse": 1.80}
FAMILY = {"notes": 0.92, "worksheet": 0.96}
#: Least and greatest scale of a block by whitespace strategy; any other strategy is balanced.
SCALES = {"airy": (0.72, 1.06), "compact": (0.88, 1.34), "packed": (0.96, 1.58), "balanced": (0.80, 1.20)}
#: Commands whose doubled backslash is collapsed.
COMMANDS = (
    "frac", "sqrt", "sum", "prod", "int", "sin", "cos", "tan", "log", "ln", "exp", "det", "lim", "partial", "infty", "alpha", "beta", "gamma",
    "delta", "theta", "lambda", "mu", "sigma", "phi", "omega", "mid", "cap", "cup",
)


def clamped(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a box inside the page, one pixel wide and high at least."""

    def side(at, size, most):
        first = clamp(at, 0, most - 1)
        return first, F.least(F.lit(most), first + F.greatest(F.lit(1), size))

    (x0, x1), (y0, y1) = side(x, w, width), side(y, h, height)
    return x0, y0, x1, y1


def warped(x: Column, y: Column, w: Column, h: Column, m: tuple, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """The box (x, y, w, h) around the four corners after the 3 x 3 matrix m, cut to the page."""

    def moved(px: Column, py: Column) -> tuple[Column, Column]:
        a, b, c = (px * float(r[0]) + py * float(r[1]) + float(r[2]) for r in m)
        far = F.abs(c) < 1e-6
        return F.when(far, px).otherwise(a / c), F.when(far, py).otherwise(b / c)

    corners = [moved(x + dx, y + dy) for dx in (F.lit(0), w) for dy in (F.lit(0), h)]
    low = [F.least(*(c[i] for c in corners)) for i in (0, 1)]
    high = [F.greatest(*(c[i] for c in corners)) for i in (0, 1)]
    whole = lambda c: c.cast("int")  # noqa: E731  towards zero
    left, top = clamp(whole(low[0]), 0, width - 1), clamp(whole(low[1]), 0, height - 1)
    return left, top, F.greatest(F.lit(0), F.least(whole(high[0] - low[0]), width - left)), F.greatest(F.lit(0), F.least(whole(high[1] - low[1]), height - top))


def quality_gate(text_before: Column, text_after: Column, math_before: Column, math_after: Column, has_equation: Column) -> Column:
    """Whether enough ink of text, and of math if the page has an equation, is left after an augmentation."""
    text = text_after / F.greatest(F.lit(1), text_before)
    math = F.when(math_before == 0, F.lit(1.0)).otherwise(math_after / F.greatest(F.lit(1), math_before))
    return (text >= 0.72) & (~has_equation | (math >= 0.82))


def scale_mismatch(profile: Column, dpi: Column) -> Column:
    """Whether the profile names a resolution that isn't the page's; other profiles are not checked."""
    name = F.coalesce(profile, F.lit("dpi300"))
    return ((name == "dpi200") & (dpi != 200)) | ((name == "dpi300") & (dpi != 300))


def priority(kind: Column) -> Column:
    """Order of blocks of a page: titles, then tables, figures and equations, then all others."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(kind == "title", 0).when(kind.isin("table", "figure", "equation"), 1).otherwise(2)


def density_shares(percent: Column) -> dict[str, Column]:
    """Shares of the four densities, piecewise linear in the percent and of sum 1."""
    p = to_percent(percent, 50.0)
    line = lambda a, b, t: a + (b - a) * t
    raw = {k: F.when(p <= 50, line(F.lit(a), b, p / 50)).otherwise(line(F.lit(b), c, (p - 50) / 50)) for k, (a, b, c) in DENSITY_AT.items()}
    total = reduce(lambda a, b: a + b, raw.values())
    return {k: F.round(v / total, 4) for k, v in raw.items()}


def font_range(profile: Column) -> Column:
    """A struct of the least and the greatest size in px of a named profile."""
    name = F.lower(F.trim(F.coalesce(profile, F.lit("Balanced"))))
    pair = lambda r: F.struct(F.lit(r[0]).alias("min_px"), F.lit(r[1]).alias("max_px"))
    found = reduce(lambda acc, r: acc.when(name.isin(*FONT_RANGES[r]), pair(r)), list(FONT_RANGES), F.when(F.lit(False), pair(BALANCED)))
    return found.otherwise(pair(BALANCED))


def content_mix(text: Column, table: Column, latex: Column) -> tuple[Column, Column, Column]:
    """Percentages that sum to 100; three zeros give the defaults."""
    parts = [to_percent(c, d) for c, d in zip((text, table, latex), MIX, strict=True)]
    total = parts[0] + parts[1] + parts[2]
    return tuple(F.round(F.when(total <= 0, F.lit(d)).otherwise(p / total * 100), 4) for p, d in zip(parts, MIX, strict=True))


def base_points(u: Column, v: Column) -> Column:
    """A font size in points from two uniforms: 5 % tiny, 65 % of six usual sizes, 20 % large, 10 % very large."""
    usual = F.lit(9.0) + F.floor(v * 6) * 0.5
    return F.when(u < 0.05, F.lit(2.0) + v * 6).when(u < 0.70, usual).when(u < 0.90, F.lit(12.0) + v * 8).otherwise(F.lit(21.0) + v * 27)


def line_height(points: Column, dpi: Column, density: Column, family: Column) -> Column:
    """Whole pixels, cut at each step; 10 at least."""
    pixels = (points * (dpi / F.lit(72.0))).cast("int")
    factor = reduce(lambda acc, k: acc.when(density == k, LEADING[k]), LEADING, F.when(F.lit(False), 1.0)).otherwise(1.40)
    base = (pixels * factor).cast("int")
    for name, by in FAMILY.items():
        base = F.when(family == name, (base * by).cast("int")).otherwise(base)
    return F.greatest(F.lit(10), base)


def contrast_gray(kind: Column, u: Column) -> Column:
    """A gray level of the contrast class, from a uniform."""
    level = lambda r: (F.lit(r[0]) + F.floor(u * (r[1] - r[0] + 1))).cast("int")
    return F.when(kind == "low", level(GRAYS["low"])).when(kind == "medium", level(GRAYS["medium"])).otherwise(level(GRAYS["high"]))


def collapsed(c: Column) -> Column:
    """Known commands with one backslash instead of two."""
    return reduce(lambda t, name: F.replace(t, F.lit(f"\\\\{name}"), F.lit(f"\\{name}")), COMMANDS, c)


def flattened(ops: Column) -> Column:
    """The names of an augmentation trace, those that are set, joined with commas."""
    return F.array_join(F.filter(ops, lambda x: x.isNotNull() & (x != "")), ",")


def scaled_side(side: Column, fill: Column, target: Column, strategy: Column) -> Column:
    """A block's side on the way from the page's fill to its target, within the strategy's limits; 8 px at least."""
    name = F.lower(F.trim(F.coalesce(strategy, F.lit("balanced"))))
    limit = lambda i: reduce(lambda acc, k: acc.when(name == k, SCALES[k][i]), SCALES, F.when(F.lit(False), 0.0)).otherwise(SCALES["balanced"][i])
    side = F.greatest(F.lit(1), side)
    scale = F.greatest(limit(0), F.least(limit(1), F.sqrt(target / F.greatest(F.lit(1e-6), fill))))
    return F.when((fill <= 1e-6) | (target <= 1e-6), side).otherwise(F.greatest(F.lit(8), F.round(side * scale).cast("long")))
