"""Scalar column expressions (X1-X24) and fixed label lookups.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen.  Fixed lookup lists are written out as when-chains
(no join, no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's labels).
# ---------------------------------------------------------------------------
PENDING, CONFIRMED, PREPARING, READY, DELIVERED, PAID, CANCELLED, AWAITING = 0, 1, 2, 3, 4, 5, 6, 10

# Order status -> display text (dashboard variant; 4 and unknown -> "—").
STATUS_TEXT = [(0, "Bekliyor"), (10, "Onay Bek."), (1, "Onaylandı"), (2, "Hazırlanıyor"),
               (3, "Hazır"), (5, "Tamamlandı"), (6, "İptal")]
STATUS_TEXT_DEFAULT = "—"
# Order status -> chip class (dashboard variant).
STATUS_CHIP = [(0, "chip-pending"), (10, "chip-pending"), (1, "chip-active"), (2, "chip-active"),
               (3, "chip-active"), (5, "chip-completed"), (6, "chip-cancelled")]
STATUS_CHIP_DEFAULT = ""

# WMO weather code -> description; anything else "Bilinmiyor".
WEATHER_CODES = [
    ((0,), "Güneşli"), ((1, 2, 3), "Bulutlu"), ((45, 48), "Sisli"), ((51, 53, 55), "Çiseli"),
    ((61, 63, 65), "Yağmurlu"), ((66, 67), "Dondurucu Yağmur"), ((71, 73, 75), "Karlı"),
    ((77,), "Kar Taneleri"), ((80, 81, 82), "Sağanak Yağışlı"), ((85, 86), "Yoğun Kar"),
    ((95,), "Gök Gürültülü Fırtına"), ((96, 99), "Dolu Fırtınası"),
]
WEATHER_UNKNOWN = "Bilinmiyor"

# Turkish weekday names, Monday first.
WEEKDAY_TR = ["Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar"]
# .NET DayOfWeek names, Sunday first.
WEEKDAY_EN = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def lookup(col: Column, pairs: Sequence[tuple[object, object]], default=None) -> Column:
    """Map literal keys to literal values, ``default`` otherwise."""
    expr = None
    for key, val in pairs:
        cond = col.isin(*key) if isinstance(key, (tuple, list)) else (col == F.lit(key))
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(default))


def status_text(status: Column) -> Column:
    return lookup(status, STATUS_TEXT, STATUS_TEXT_DEFAULT)


def status_chip(status: Column) -> Column:
    return lookup(status, STATUS_CHIP, STATUS_CHIP_DEFAULT)


def weather_text(code: Column) -> Column:
    return lookup(code, WEATHER_CODES, WEATHER_UNKNOWN)


def contains_ci(text: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.lower(text).contains(F.lower(n))


def first_match_tag(text: Column, rules: Sequence[tuple[Sequence[str], str]],
                    default: str) -> Column:
    """The tag of the first rule any of whose keywords occurs in ``text``
    (lower-cased).  Rules are an ordered, fixed-size list."""
    low = F.lower(text)
    expr = None
    for keywords, tag in rules:
        cond = None
        for kw in keywords:
            c = low.contains(kw)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    return expr.otherwise(F.lit(default))


def words(text: Column) -> Column:
    """Lower-case, '-' -> blank, split on runs of blanks, drop empties."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(text), "-", " ")), r"\s+")
    return F.filter(parts, lambda w: w != "")


def split_trim(text: Column, sep: str = ",") -> Column:
    """Split on a separator and trim every part."""
    return F.transform(F.split(text, sep), lambda s: F.trim(s))


def set_text(arr: Column) -> Column:
    """Sorted set joined as ', ' text."""
    return F.array_join(F.array_sort(arr), ", ")


def weekday_sun0(ts: Column) -> Column:
    """SQLite %w numbering, Sunday = 0."""
    return F.dayofweek(ts) - 1


def weekday_mon0(ts: Column) -> Column:
    """Pandas numbering, Monday = 0."""
    return F.weekday(ts)


def weekday_name_tr(ts: Column) -> Column:
    """Turkish weekday name."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_TR]), F.weekday(ts) + 1)


def weekday_name_en(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_EN]), F.dayofweek(ts))


def group_estimate(n_items: Column) -> Column:
    """max(1, n // 2)."""
    return F.greatest(F.lit(1), F.floor(n_items / 2)).cast("long")


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """X19."""
    if lo is not None:
        x = F.greatest(F.lit(lo), x)
    if hi is not None:
        x = F.least(F.lit(hi), x)
    return x


def blank_default(x: Column, default) -> Column:
    """NULL or empty text -> default."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def table_label(label: Column) -> Column:
    """P20: prefix "Masa " unless the label already starts with it (any case)."""
    return F.when(F.lower(label).startswith("masa"), label).otherwise(
        F.concat(F.lit("Masa "), label))


def money_sum(x: Column) -> Column:
    """Decimal sum pinned to decimal(38,2)."""
    return F.sum(x).cast("decimal(38,2)")
