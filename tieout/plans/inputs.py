"""Cleaned inputs built from the driver tables through the fixture views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineages
from ..sources.fixtures import register_fixtures
from ..sources.readers import clean_deposits, clean_ledger, clean_payroll, ledger_totals, payroll_totals

# Reviewer annotations derived from the fixture clients (F7 input).
F_ANNOTATIONS = """
SELECT coalesce(ledger_name, payroll_name) AS client_name,
  CASE WHEN cid % 2 = 0 THEN 'Billed ' || CAST(cid AS VARCHAR(9)) ELSE '' END AS billing_notes,
  CASE WHEN cid % 4 = 1 THEN NULL ELSE 'Reviewed ' || CAST(cid AS VARCHAR(9)) END AS notes,
  CASE cid % 4 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Review' ELSE 'Issue' END AS status
FROM f_clients WHERE cid % 3 = 0
"""


@dataclass
class Inputs:
    ledger: DataFrame
    payroll: DataFrame
    deposits: DataFrame
    rules: DataFrame
    order_lines: DataFrame
    annotations: DataFrame


def fixture_inputs(spark: SparkSession, sf_dir: str, materialize: bool = False, totals: bool = False) -> Inputs:
    """Cleaned inputs. ``materialize=True`` writes the cleaned ledger and
    payroll once as parquet tables (``cut_lineages``) for pipelines that read
    their rows several times; deposits (read once) and single-pass queries stay lazy.
    ``totals=True`` hands on (and writes) the totals of both instead of the rows,
    for pipelines that only aggregate them."""
    register_fixtures(spark, sf_dir)
    ledger = clean_ledger(spark.table("f_ledger"), columns={"amount": "amount_text"})
    payroll = clean_payroll(spark.table("f_payroll"))
    deposits = clean_deposits(spark.table("f_deposits"), columns={"amount": "amount_text"})
    if totals:
        ledger, payroll = cut_lineages(ledger_totals(spark.table("f_ledger"), columns={"amount": "amount_text"}),
                                       payroll_totals(spark.table("f_payroll")))
    elif materialize:
        ledger, payroll = cut_lineages(ledger, payroll)
    return Inputs(ledger=ledger, payroll=payroll, deposits=deposits, rules=spark.table("f_rules"),
                  order_lines=spark.table("f_order_lines"), annotations=spark.sql(F_ANNOTATIONS))
