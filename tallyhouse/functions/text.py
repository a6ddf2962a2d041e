"""KPI values as text columns. NULL in, NULL out (percent change: a dash).

``format_number`` rounds half-even on the exact binary value, with ',' between
thousands and '.' before decimals; the separators are then exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CHANGE = "—"


def _continental(text: Column) -> Column:
    return F.translate(text, ",.", " ,")


def whole_text(value: Column) -> Column:
    """``1234567`` as ``1 234 567``; decimals are cut off, not rounded."""
    return F.translate(F.format_number(value.cast("bigint"), 0), ",", " ")


def dotted_text(value: Column) -> Column:
    """``1234567`` as ``1.234.567``."""
    return F.translate(F.format_number(value.cast("bigint"), 0), ",", ".")


def money_text(value: Column) -> Column:
    """``1234.5`` as ``€ 1 234,50``."""
    return F.concat(F.lit("€ "), _continental(F.format_number(value, 2)))


def km_text(value: Column) -> Column:
    """``1234.56`` as ``1 234,6 km``."""
    return F.concat(_continental(F.format_number(value, 1)), F.lit(" km"))


def percent_text(value: Column) -> Column:
    """``12.34`` as ``12.3%``."""
    return F.concat(_plain(value, 1), F.lit("%"))


def change_text(value: Column) -> Column:
    """``1.23`` as ``+1.2%``, ``-1.23`` as ``-1.2%``, NULL as a dash."""
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, _plain(value, 1), F.lit("%")), F.lit(NO_CHANGE))


def billions_text(value: Column) -> Column:
    """``1234567890`` as ``$1.23B``."""
    return F.concat(F.lit("$"), _plain(value / 1e9, 2), F.lit("B"))


def _plain(value: Column, decimals: int) -> Column:
    return F.translate(F.format_number(value, decimals), ",", "")
