"""Column functions: years, flags, numbers, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_year(x: Column | str) -> Column:
    """Nullable year of text: blank, 'nan' and other words give NULL, decimals are cut toward zero (OP-030)."""
    d = F.trim(_c(x).cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d).try_cast("int")


def norm_sex(x: Column | str) -> Column:
    """M, F or '' (OP-031)."""
    u = F.upper(F.trim(_c(x)))
    return F.when(u.isin("M", "F"), u).otherwise(F.lit(""))


def bucket(x: Column | str, width: int) -> Column:
    """Start of the bucket of that width, rounded down also below zero (OP-032)."""
    return (F.floor(_c(x) / width) * width).cast("int")


def bround_median(x: Column | str) -> Column:
    """Median with banker's rounding, an aggregate (OP-033)."""
    return F.bround(F.median(_c(x))).cast("int")


def upper_median(x: str) -> Column:
    """Upper median of the non-NULL values of a column, an aggregate (OP-034): the middle one, the greater of two.

    The state of the aggregate is one counter per distinct value, so a hot group stays as small as the range of years.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)").cast("int")


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Values moved into [lo, hi]; NULL stays NULL (OP-036)."""
    out = _c(x)
    if lo is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(hi)))
    return out


def years_in_window(birth: Column | str, death: Column | str, lo: int, hi: int, inclusive: bool = True) -> Column:
    """Years of a life inside a window, never below zero (OP-037)."""
    n = F.least(_c(death), F.lit(hi)) - F.greatest(_c(birth), F.lit(lo)) + (1 if inclusive else 0)
    return F.when(_c(birth).isNotNull() & _c(death).isNotNull(), F.greatest(n, F.lit(0)))


def split_set(x: Column | str, sep: str = ";") -> Column:
    """Sorted distinct trimmed parts of a joined string; NULL gives the empty array (OP-052)."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), sep), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def join_set(x: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_c(x))), sep)


def truncate(x: Column | str, n: int) -> tuple[Column, Column]:
    """The first n characters, and whether there were more (OP-051)."""
    return F.substring(_c(x), 1, n), F.coalesce(F.length(_c(x)) > n, F.lit(False))


def first_text(*xs: Column | str) -> Column:
    """First value that isn't blank (OP-050)."""
    return F.coalesce(*[F.when(F.length(F.trim(_c(x))) > 0, _c(x)) for x in xs])


def remap(x: Column | str, table: dict[str, str]) -> Column:
    """Legacy values renamed, others kept (OP-056)."""
    out = _c(x)
    for a, b in table.items():
        out = F.when(_c(x) == a, F.lit(b)).otherwise(out)
    return out


def couple_year(ba: Column | str, da: Column | str, bb: Column | str, db: Column | str, proxy: str = "birth") -> Column:
    """Floored midpoint of two lives: of births, deaths or midlives; NULL if a part is missing (OP-061)."""
    mid = lambda a, b: F.floor((_c(a) + _c(b)) / 2)
    if proxy == "birth":
        return mid(ba, bb).cast("int")
    if proxy == "death":
        return mid(da, db).cast("int")
    if proxy == "midlife":
        return F.floor((mid(ba, da) + mid(bb, db)) / 2).cast("int")
    raise ValueError(proxy)


def overlaps(b: Column | str, d: Column | str, lo: Column | int, hi: Column | int) -> Column:
    """Closed lives that meet [lo, hi]; a missing end never does (OP-071)."""
    return F.coalesce((_c(b) <= hi) & (_c(d) >= lo), F.lit(False))


def wilson(k: Column | str, n: Column | str, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Share, lower and upper end of the Wilson interval; NULL where n is 0 (OP-122)."""
    k, n = _c(k).cast("double"), F.when(_c(n) > 0, _c(n).cast("double"))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return p, centre - half, centre + half


def format_p(p: Column | str) -> Column:
    """'<0.001', else three decimals (OP-027)."""
    return F.when(_c(p) < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", _c(p).cast("double")))


def stars(p: Column | str) -> Column:
    return F.when(_c(p) < 0.01, "***").when(_c(p) < 0.05, "**").when(_c(p) < 0.1, "*").otherwise("")


def format_digits(x: Column | str) -> Column:
    """Digits by magnitude (OP-027): 1 from 100 on, 2 from 10 on, 3 below."""
    v = _c(x).cast("double")
    return F.when(F.abs(v) >= 100, F.format_string("%.1f", v)).when(F.abs(v) >= 10, F.format_string("%.2f", v)).otherwise(F.format_string("%.3f", v))


def item_id(n: Column | str, prefix: str = "M") -> Column:
    return F.format_string(prefix + "%03d", _c(n).cast("int"))
