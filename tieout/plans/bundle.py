"""Full reconciliation (E6): every result of one run as lazy DataFrames.

The client match table is computed once and checkpointed (the source
recomputes it for the summary and again for the variances); the summary, the
employee matches and the variance list all read that one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import clients, pivots, recon
from ..session import cut_lineage


@dataclass
class Reconciliation:
    ledger_client_item: DataFrame
    ledger_rep_client: DataFrame
    ledger_invoices: DataFrame
    ledger_employee_job_site: DataFrame
    payroll_bill_to_employee: DataFrame
    ledger_client_item_tree: DataFrame
    ledger_rep_client_tree: DataFrame
    payroll_bill_to_tree: DataFrame
    matches: DataFrame
    summary: DataFrame
    employee_matches: DataFrame
    variances: DataFrame
    deposits: DataFrame | None
    # declared by the source but never filled there; here: rows set aside by
    # the opt-in payroll filters (A12/A13), empty unless the caller fills them
    filtered_records: DataFrame | None = None
    excluded_records: DataFrame | None = None


def reconcile(ledger: DataFrame, payroll: DataFrame, deposits: DataFrame | None = None,
              rules: DataFrame | None = None, materialize_inputs: bool = True) -> Reconciliation:
    """``ledger`` / ``payroll`` / ``deposits`` are cleaned inputs (``sources.readers``);
    ``rules`` defaults to the fixed exception rules. The cleaned inputs are
    read by every result, so by default they are written once as parquet
    tables under the checkpoint dir (one narrow write instead of re-parsing
    the raw extracts for each consumer)."""
    rules = rules if rules is not None else clients.default_rules(ledger.sparkSession)
    if materialize_inputs:
        ledger, payroll = cut_lineage(ledger), cut_lineage(payroll)
        deposits = cut_lineage(deposits) if deposits is not None else None
    cm = clients.unified_matches(ledger, payroll, rules)
    emp = recon.employee_level(cm, ledger, payroll)[0]
    return Reconciliation(
        ledger_client_item=pivots.ledger_client_item(ledger),
        ledger_rep_client=pivots.ledger_rep_client(ledger),
        ledger_invoices=pivots.ledger_invoices(ledger),
        ledger_employee_job_site=pivots.ledger_employee_job_site(ledger),
        payroll_bill_to_employee=pivots.payroll_bill_to_employee(payroll),
        ledger_client_item_tree=pivots.ledger_client_item_tree(ledger),
        ledger_rep_client_tree=pivots.ledger_rep_client_tree(ledger),
        payroll_bill_to_tree=pivots.payroll_bill_to_tree(payroll),
        matches=cm.matches,
        summary=recon.client_summary(cm, ledger, payroll, deposits),
        employee_matches=emp,
        variances=recon.variance_analysis(cm, ledger, payroll, emp),
        deposits=deposits,
    )
