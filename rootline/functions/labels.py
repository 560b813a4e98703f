"""Labels and ids that differ only in case or surrounding white space name the same thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around a label.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0  　"


def strip(column: Column) -> Column:
    """``column`` without white space at its ends; null stays null."""
    return F.btrim(column, F.lit(BLANKS))


def label(column: Column) -> Column:
    """The name of a label: lower case, without white space at its ends; blank is null."""
    return F.nullif(F.lower(strip(column)), F.lit(""))


def score(column: Column) -> Column:
    """A number to rank by: NaN is null, since it compares above every number in Spark."""
    return F.when(~F.isnan(column), column)
