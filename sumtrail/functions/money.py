from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits behind the point that a price and a discount may have.
PRICE_DIGITS = 4
DISCOUNT_DIGITS = 6
# A net price is kept as whole units and two groups of digits behind the point.
GROUP = 10 ** ((PRICE_DIGITS + DISCOUNT_DIGITS) // 2)


def exact(name: str, digits: int) -> Column:
    """The double column ``name`` as a decimal of 19 digits, ``digits`` behind the point.

    A value that is not such a decimal (NaN, infinite, too large, or with more digits)
    ends the query with an error that names column and value. NULL stays NULL. This does
    not depend on ANSI mode.
    """
    value = F.col(name)
    decimal = value.try_cast(f"decimal(19,{digits})")
    text = F.concat(F.lit(f"{name}: not a decimal with {digits} digits behind the point: "), value.cast("string"))
    same = F.coalesce(decimal.cast("double") == value, F.lit(False))
    return F.when(value.isNull() | same, decimal).otherwise(F.raise_error(text).cast(f"decimal(19,{digits})"))


def net_price(price: str, discount: str) -> tuple[Column, Column, Column]:
    """``price * (1 - discount)``, exactly, as three bigints.

    Adding doubles gives a last digit that depends on the order of the additions, so a
    retried task could change a total; bigints add up to the same value in any order,
    and faster than decimals. The result is the whole units, rounded down, and the ten
    digits behind the point in two groups, so that sums have room for 1e13 rows.
    """
    net = exact(price, PRICE_DIGITS) * (F.lit(1) - exact(discount, DISCOUNT_DIGITS))
    units = F.floor(net)
    rest = ((net - units) * GROUP * GROUP).cast("bigint")
    return units.cast("bigint"), F.call_function("div", rest, F.lit(GROUP)), rest % GROUP


def amount(units: str, high: str, low: str) -> Column:
    """The decimal that sums of the columns of ``net_price`` stand for."""
    whole, high, low = (F.col(c).cast("decimal(19,0)") for c in (units, high, low))
    return whole + high / GROUP + low / GROUP / GROUP
