"""Paper identifiers, months and date windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier formats.
MODERN_ID = r"^(\d{2})(\d{2})\.\d{4,5}"
LEGACY_ID = r"^[A-Za-z.-]+/(\d{2})(\d{2})\d{3}"
URL_PREFIX = r"(?i)^(https?://arxiv\.org/abs/|arxiv:)"


def canonical_id(c: Column) -> Column:
    """Trimmed id without prefix and version; a version needs more than four characters before it."""
    bare = F.regexp_replace(F.trim(c), URL_PREFIX, "")
    return F.regexp_replace(bare, r"(?i)^(.{4,}?)v\d+$", "$1")


def id_month(c: Column, legacy_pivot: int = 90, modern_pivot: int | None = None) -> Column:
    """year * 100 + month of an id; null for other formats and months outside 1 to 12.

    Two-digit years from the pivot on lie in the 1900s; without a pivot none does.
    """
    i = canonical_id(c)
    modern, legacy = F.regexp_extract(i, MODERN_ID, 1), F.regexp_extract(i, LEGACY_ID, 1)
    yy = F.when(modern != "", modern).otherwise(legacy)
    mm = F.when(modern != "", F.regexp_extract(i, MODERN_ID, 2)).otherwise(F.regexp_extract(i, LEGACY_ID, 2))
    y, m = F.try_to_number(yy, F.lit("99")).cast("int"), F.try_to_number(mm, F.lit("99")).cast("int")
    pivot = F.when(modern == "", F.lit(legacy_pivot))
    if modern_pivot is not None:
        pivot = F.coalesce(pivot, F.lit(modern_pivot))
    year = F.when(y >= F.coalesce(pivot, F.lit(100)), 1900 + y).otherwise(2000 + y)
    return F.when((yy != "") & m.between(1, 12), year * 100 + m)


def gate_year(c: Column) -> Column:
    """Year of a modern id, 2000s below 80; legacy ids have none."""
    y = F.regexp_extract(F.trim(c), MODERN_ID, 1)
    n = F.try_to_number(y, F.lit("99")).cast("int")
    return F.when(y != "", F.when(n < 80, 2000 + n).otherwise(1900 + n))


def month_of_fields(*fields: Column) -> Column:
    """The first field that starts with YYYY-MM or YYYYMM, as year * 100 + month."""
    one = [F.when(F.regexp_like(f, F.lit(r"^\d{4}-?(0[1-9]|1[0-2])")), F.concat(F.substring(f, 1, 4), F.substring(F.regexp_replace(f, "-", ""), 5, 2)).cast("int")) for f in fields]
    return F.coalesce(*one)


def month_text(m: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(m / 100).cast("int"), (m % 100).cast("int"))


def strict_month(c: Column) -> Column:
    """YYYY-MM and nothing else, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$")), F.concat(F.substring(c, 1, 4), F.substring(c, 6, 2)).cast("int"))


def minimum_year(explicit: int | None = None, configured: int | None = None, recent_years: int | None = None, as_of: int | None = None) -> int | None:
    """The first of an explicit, a configured and a relative lower year; zero or less switches the gate off."""
    for y in (explicit, configured):
        if y is not None:
            return y if y > 0 else None
    return as_of - recent_years if recent_years and recent_years > 0 and as_of else None


def citer_time(citer: Column, query: Column) -> Column:
    """prior, same, later or unknown: when a citer's month is, seen from the query's."""
    return F.when(citer.isNull() | query.isNull(), "unknown").when(citer < query, "prior").when(citer == query, "same").otherwise("later")


def citer_allowed(citer: Column, query: Column, keep_same: bool = True, keep_unknown: bool = True) -> Column:
    """Whether a citer's evidence is available at the query's month."""
    t = citer_time(citer, query)
    return (t == "prior") | ((t == "same") & F.lit(keep_same)) | ((t == "unknown") & F.lit(keep_unknown))


def date_windows(start: Column, end: Column, days: int) -> Column:
    """Inclusive windows of at most `days` days from start to end, as an array of structs."""
    firsts = F.sequence(start, end, F.expr(f"interval {days} days"))
    return F.transform(firsts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))


def next_since(last_done: Column, configured: Column) -> Column:
    """The day after the last completed one, else the configured start."""
    return F.coalesce(F.date_add(last_done, 1), configured)


def repaired_key(c: Column) -> Column:
    """hepth9901001 as hepth/9901001."""
    return F.regexp_replace(c, r"^([A-Za-z.-]+)(\d{7})$", "$1/$2")
