"""String-building and string-parsing column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns the question parser uses (fixed values).
STORE_PATTERN = r"store\s+(\d+)"
DATE_PATTERN = r"(\d{4})-(\d{2})-(\d{2})"


def money2(x: Column) -> Column:
    """Two-decimal text of a number, rounded half-up on the decimal value."""
    return x.cast("decimal(18,2)").cast("string")


def record_text(date: Column, store: Column, city: Column | None, family: Column,
                sales: Column, onpromotion: Column | None = None,
                is_holiday: Column | None = None) -> Column:
    """``On {date}, Store {n}[ in {city}] sold {family} with sales of ${x}``
    plus `` (on promotion)`` / `` during a holiday`` when the flag is set.

    A column passed as ``None`` is an absent field.  A null city is absent; a
    null flag counts as set, as a missing number is truthy in the source.
    """
    parts = [F.lit("On "), date.cast("string"), F.lit(", Store "), store.cast("string")]
    if city is not None:
        parts.append(F.when(city.isNotNull(), F.concat(F.lit(" in "), city)).otherwise(F.lit("")))
    parts += [F.lit(" sold "), family, F.lit(" with sales of $"), money2(sales)]
    if onpromotion is not None:
        parts.append(F.when(F.coalesce(onpromotion != 0, F.lit(True)), F.lit(" (on promotion)"))
                     .otherwise(F.lit("")))
    if is_holiday is not None:
        parts.append(F.when(F.coalesce(is_holiday != 0, F.lit(True)), F.lit(" during a holiday"))
                     .otherwise(F.lit("")))
    return F.concat(*parts)


def record_id(date: Column, store: Column, family: Column, row_key: Column) -> Column:
    """``{date}_{store}_{family, spaces as _}_{row key}``."""
    return F.concat_ws("_", date.cast("string"), store.cast("string"),
                       F.replace(family, F.lit(" "), F.lit("_")), row_key.cast("string"))


def question_store(q: Column) -> Column:
    """First ``store <digits>`` in the lower-cased question, as int, else null.
    Digits beyond an int stay a filter that no store meets (-1)."""
    s = F.nullif(F.regexp_extract(F.lower(q), STORE_PATTERN, 1), F.lit(""))
    return F.when(s.isNotNull(), F.coalesce(s.try_cast("int"), F.lit(-1)))


def question_date(q: Column) -> Column:
    """First ``dddd-dd-dd`` in the question, whole match, not validated."""
    return F.nullif(F.regexp_extract(q, DATE_PATTERN, 0), F.lit(""))


def filters_text(store: Column, date: Column) -> Column:
    """The filter dict as the source prints it, e.g. ``{'store_nbr': 25, 'date': '2017-12-25'}``."""
    s = F.when(store.isNotNull(), F.concat(F.lit("'store_nbr': "), store.cast("string")))
    d = F.when(date.isNotNull(), F.concat(F.lit("'date': '"), date, F.lit("'")))
    return F.when(store.isNull() & date.isNull(), F.lit(None)).otherwise(
        F.concat(F.lit("{"), F.concat_ws(", ", s, d), F.lit("}")))


def currency(x: Column, prefix: str = "$") -> Column:
    """``$1,234.50``: thousands separators, two decimals, half-up."""
    return F.concat(F.lit(prefix), F.format_number(x.cast("decimal(38,2)"), 2))


def signed_percent(x: Column) -> Column:
    """``+12.3%`` / ``-4.0%``: one decimal, half-up, explicit sign."""
    return F.format_string("%+.1f%%", F.round(x.cast("decimal(38,6)"), 1).cast("double"))


def store_label(store: Column, city: Column) -> Column:
    return F.concat(F.lit("Store "), store.cast("string"), F.lit(" - "), city)


def store_from_label(label: Column) -> Column:
    return F.split(label, " ").getItem(1).try_cast("int")
