"""Scalar string functions as Catalyst column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   year suffix pattern "(dddd)" at the very end of a title, removed as the last 7 characters " (dddd)"
#   trailing articles moved to the front, tried in this order: ", The"  ", A"  ", An"
#   IMDb ids: prefix "tt", digits zero-padded to at least 7
#   alias separators: " (a.k.a. " in catalogue titles, " (aka " in plot titles
YEAR_AT_END = r"\((\d{4})\)$"
ARTICLES = ("The", "A", "An")
IMDB_PREFIX = "tt"
IMDB_DIGITS = 7
CATALOGUE_ALIAS = " (a.k.a. "
PLOT_ALIAS = " (aka "


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Remove leading/trailing whitespace of every kind (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def title_year(c: Column | str) -> Column:
    """4-digit year in ``(...)`` at the end of the title, NULL when absent."""
    return F.nullif(F.regexp_extract(_c(c), YEAR_AT_END, 1), F.lit("")).cast("int")


def drop_last(c: Column | str, n: int) -> Column:
    """All but the last ``n`` characters."""
    c = _c(c)
    return c.substr(F.lit(1), F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def title_without_year(c: Column | str) -> Column:
    """Catalogue titles end with `` (YYYY)``: drop the last 7 characters."""
    return drop_last(_c(c), 7)


def move_article(name: Column | str) -> Column:
    """``Matrix, The`` -> ``The Matrix``; first matching suffix only, case-sensitive."""
    name = _c(name)
    expr = None
    for art in ARTICLES:
        suffix = ", " + art
        moved = F.concat(F.lit(art + " "), drop_last(name, len(suffix)))
        expr = F.when(name.endswith(suffix), moved) if expr is None else expr.when(name.endswith(suffix), moved)
    return expr.otherwise(name)


def imdb_id(raw: Column | str) -> Column:
    """``tt`` + digits padded to at least 7 (``lpad`` alone would truncate longer ids)."""
    raw = _c(raw)
    return F.concat(
        F.lit(IMDB_PREFIX),
        F.when(F.length(raw) >= IMDB_DIGITS, raw).otherwise(F.lpad(raw, IMDB_DIGITS, "0")),
    )


def strip_imdb_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "^" + IMDB_PREFIX, "")


def first_alias(title: Column | str) -> Column:
    """Display form: title without year and only its first alias."""
    return F.substring_index(title_without_year(title), CATALOGUE_ALIAS, 1)


def is_digits(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(r"^[0-9]+$"), F.lit(False))


def is_decimal(c: Column | str) -> Column:
    """Text Python's float() accepts in the forms we produce (guards Spark's '4.0d' leniency)."""
    return F.coalesce(py_strip(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def to_double(c: Column | str) -> Column:
    return F.when(is_decimal(c), py_strip(c).try_cast("double"))
