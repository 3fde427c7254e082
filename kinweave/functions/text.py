"""Text columns: cleaning, tokens, ordered and multi-label classifiers, templates."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_tags(x: Column | str, collapse: bool = True) -> Column:
    """Markup replaced by blanks; runs of white space become one blank (OP-038)."""
    out = F.regexp_replace(_c(x), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " ")) if collapse else out


def _mapped(f, x: Column | str) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return F.pandas_udf(run, "string")(_c(x))


def unescape(x: Column | str) -> Column:
    """HTML entities decoded (OP-038); Spark has no built-in for them."""
    return _mapped(html.unescape, x)


def strip_diacritics(x: Column | str) -> Column:
    """Letters without their combining marks (OP-039); Spark has no decomposition."""
    return _mapped(lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), x)


def orthographic(x: Column | str) -> Column:
    """Lower case, j as i, k as c, ligatures opened, brackets dropped; give it text without diacritics (OP-040)."""
    out = F.lower(_c(x))
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "jk[]()", "ic")


def first_name_token(name: Column | str, stop: list[str]) -> Column:
    """First alphabetic token before the comma that is no stop word, lower case; NULL if there is none (OP-041)."""
    half = F.split_part(F.lower(_c(name)), F.lit(","), F.lit(1))
    ok = F.filter(F.split(F.trim(half), "\\s+"), lambda t: t.rlike("^\\p{L}+$") & ~t.isin(stop))
    return F.when(F.size(ok) > 0, F.element_at(ok, 1))


def contains_any(x: Column | str, roots: Column) -> Column:
    """Whether any root of an array column occurs in the text (OP-042)."""
    return F.coalesce(F.exists(roots, lambda r: F.contains(_c(x), r)), F.lit(False))


def has_marker(x: Column | str, markers: list[str]) -> Column:
    """Whether any of a fixed list of words occurs, in lower case (OP-043)."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(F.lower(_c(x)), F.lit(m))
    return F.coalesce(out, F.lit(False))


def ordered_class(x: Column | str, rules: list[tuple[str, object]], default: object = None) -> Column:
    """Value of the first rule whose pattern matches (OP-044, OP-045); the order of the rules decides."""
    out = None
    for pattern, value in rules:
        hit = _c(x).rlike(pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def multi_flags(x: Column | str, patterns: dict[str, str], prefix: str = "is_") -> list[Column]:
    """One 0/1 column per pattern (OP-046); NULL text gives 0."""
    return [F.coalesce(_c(x).rlike(p).cast("int"), F.lit(0)).alias(prefix + k) for k, p in patterns.items()]


def span_midpoint(x: Column | str) -> Column:
    """Floor of the mean of '(1198-1216)' (OP-047)."""
    a = F.regexp_extract(_c(x), "\\((\\d{3,4})\\s*-\\s*(\\d{3,4})\\)", 1).try_cast("int")
    b = F.regexp_extract(_c(x), "\\((\\d{3,4})\\s*-\\s*(\\d{3,4})\\)", 2).try_cast("int")
    return F.floor((a + b) / 2).cast("int")


def first_json_year(x: Column | str, field: str = "date_deb_annee") -> Column:
    """First usable year of a JSON object or list of objects (OP-048); anything else gives NULL."""
    s = F.trim(_c(x))
    as_list = F.when(s.startswith("["), s).when(s.startswith("{"), F.concat(F.lit("["), s, F.lit("]")))
    items = F.from_json(as_list, f"array<struct<{field}:string>>")
    years = F.filter(F.transform(items, lambda i: F.trim(i[field]).try_cast("double").try_cast("int")), lambda y: y.isNotNull())
    return F.when(F.size(years) > 0, F.element_at(years, 1))


def list_or_text(x: Column | str, sep: str = " | ") -> Column:
    """Plain text, or the members of a JSON list joined (T-14)."""
    s = F.trim(_c(x))
    return F.when(s.startswith("["), F.array_join(F.from_json(s, "array<string>"), sep)).otherwise(_c(x))


def render(template: str, **fields: Column | str) -> Column:
    """A template with {name} places filled from columns; NULL leaves a place empty (OP-053)."""
    out = F.lit(template)
    for k, v in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(_c(v).cast("string"), F.lit("")))
    return out


def pipe_table(rows: Column, fields: list[str]) -> Column:
    """Array of structs as lines of fields between pipes (OP-053)."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(" | ", *[F.coalesce(r[f].cast("string"), F.lit("")) for f in fields])), "\n")


def split_at(x: Column | str, marker: str) -> tuple[Column, Column]:
    """Text before a marker, and from it on; without it all is before (OP-054)."""
    at = F.instr(_c(x), marker)
    return F.when(at > 0, F.substring(_c(x), F.lit(1), at - 1)).otherwise(_c(x)), F.when(at > 0, F.substring(_c(x), at, F.length(_c(x)))).otherwise(F.lit(""))
