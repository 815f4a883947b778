"""How aggregates read cleaned rows or their totals.

Client matching, employee totals, summary, variances and record counts read the extracts several times, but only ever aggregate them. So they
also take the totals of ``sources.readers`` (``ledger_totals``, ``payroll_totals``) in the place of the rows, and return the same: sums, least
amounts, counts and distinct values of a coarser key come from those of a finer one without loss (decimals add exactly).
What differs between rows and totals is written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_totals(df: DataFrame) -> bool:
    return "n_rows" in df.columns


def summed(df: DataFrame, c: str) -> Column:
    """Sum of ``c``, in the type that the sum of the rows has."""
    return F.sum(c).cast(df.schema[c].dataType) if _is_totals(df) else F.sum(c)


def least_amount(df: DataFrame) -> Column:
    """The least ledger amount behind each line of ``df``, as ``amount``."""
    return F.col("amount_min" if _is_totals(df) else "amount").alias("amount")


def row_count(df: DataFrame) -> Column:
    return F.coalesce(F.sum("n_rows"), F.lit(0)) if _is_totals(df) else F.count(F.lit(1))
