"""Batch job: reconcile extract files and write every result as a table.

    python -m tieout.plans.run --ledger qb.csv --payroll payroll.csv [--deposits dep.csv]
        [--rules rules.csv] [--format csv|parquet] --out /shared/recon/2026-11-29

Each result of :func:`tieout.plans.bundle.reconcile` is written under ``--out``
as parquet (nested pivot form is not written; the flattened trees are).
"""

from __future__ import annotations

import argparse

from ..session import build_session
from ..sources.readers import read_deposits, read_ledger, read_payroll
from .bundle import reconcile

OUTPUTS = ["ledger_client_item", "ledger_rep_client", "ledger_invoices", "ledger_employee_job_site",
           "payroll_bill_to_employee", "ledger_client_item_tree", "ledger_rep_client_tree", "payroll_bill_to_tree",
           "matches", "summary", "employee_matches", "variances"]


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--ledger", required=True)
    ap.add_argument("--payroll", required=True)
    ap.add_argument("--deposits")
    ap.add_argument("--rules", help="table with columns row_no, name_a, name_b")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = build_session()
    rules = None
    if a.rules:
        rules = (spark.read.option("header", True).csv(a.rules) if a.format == "csv" else spark.read.parquet(a.rules))
    r = reconcile(read_ledger(spark, a.ledger, a.format), read_payroll(spark, a.payroll, a.format),
                  read_deposits(spark, a.deposits, a.format) if a.deposits else None, rules)
    for name in OUTPUTS:
        getattr(r, name).write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
