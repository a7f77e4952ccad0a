"""Rounding, ordering and money rules that plain Spark defaults would get wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Item conditions in their order.
CONDITIONS = ["NEW_SEALED", "NEW_OPENED", "USED_COMPLETE", "USED_INCOMPLETE", "DAMAGED", "UNKNOWN"]


def half_up(value: Column, digits: int = 2) -> Column:
    """A double rounded half toward plus infinity on its binary value."""
    scale = 10**digits
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / scale


def half_away(value: Column, digits: int = 2) -> Column:
    """A number rounded half away from zero as a decimal."""
    return F.round(value.cast("decimal(20,8)"), digits)


def ordinal(value: Column, order: list[str]) -> Column:
    """The place of an enumeration's value, from 1; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def differs(old: Column, new: Column) -> Column:
    """Whether two values differ, nulls being equal to each other."""
    return ~old.eqNullSafe(new)


def amount(value: Column) -> Column:
    """A finite number, or null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


# Currencies without decimals.
ZERO_DECIMAL = ["JPY", "KRW", "VND", "CLP", "ISK"]


def money_text(value: Column, currency: Column) -> Column:
    """An amount with separators and its currency's decimals, the code in front."""
    whole = currency.isin(*ZERO_DECIMAL)
    return F.concat_ws(" ", currency, F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2)))


def percent_text(value: Column) -> Column:
    """A percentage with its sign and one decimal."""
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.1f%%", value.cast("double")))


def trend(value: Column, flat: float = 0.05) -> Column:
    return F.when(value.isNull() | (F.abs(value) < flat), "flat").when(value > 0, "up").otherwise("down")
