"""End-to-end properties on the sf0.001 fixture (SURVEY section 5 (d))."""

import pytest
from pyspark.sql import functions as F

from tieout.operators import clients, recon
from tieout.plans.bundle import reconcile
from tieout.plans.inputs import fixture_inputs

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def result(spark):
    i = fixture_inputs(spark, SF_SMALL)
    return i, reconcile(i.ledger, i.payroll, i.deposits, i.rules)


def test_all_match_types_occur(result):
    _, r = result
    types = {x.match_type for x in r.matches.select("match_type").distinct().collect()}
    assert types == {"Exact", "ExceptionRule", "AmountZeroOut", "Normalized", "FirstWords", "Fuzzy",
                     "LedgerOnly", "PayrollOnly"}


def test_greedy_is_one_to_one(spark, result):
    i, _ = result
    cm = clients.unified_matches(i.ledger, i.payroll, i.rules)
    _, _, assigned = recon.employee_level(cm, i.ledger, i.payroll)
    dup_p = assigned.groupBy("unified_name", F.lower("p_name")).count().filter("count > 1").count()
    dup_l = assigned.groupBy("unified_name", "l_item").count().filter("count > 1").count()
    assert dup_p == 0 and dup_l == 0 and assigned.count() > 0


def test_ledger_total_preserved(result):
    i, r = result
    total = i.ledger.agg(F.sum("amount")).first()[0]
    summary_total = r.summary.agg(F.sum("qb_balance")).first()[0]
    assert total == summary_total


def test_variance_types(result):
    _, r = result
    types = {x.variance_type for x in r.variances.select("variance_type").distinct().collect()}
    assert {"Ledger Only Client", "Payroll Only Client", "Employee Amount Variance"} <= types


def test_deposit_truncation(spark):
    raw = spark.createDataFrame(
        [(1, "Deposit", "A", "10.00", "2024-01-01", ""), (2, "", "B", "bad", "2024-01-01", ""),
         (3, "Deposit", "C", "5.00", "2024-01-02", "77"), (4, "Deposit", "D", "x", "2024-01-02", ""),
         (5, "Deposit", "E", "1.00", "2024-01-03", "")],
        "row_idx long, type string, client_name string, amount string, deposit_date string, num string")
    from tieout.sources.readers import clean_deposits
    got = [(r.client_name, r.payment_method, r.check_number) for r in clean_deposits(raw).orderBy("row_idx").collect()]
    assert got == [("A", "ACH", ""), ("C", "Check", "77")]


def test_missing_payroll_column_gives_empty(spark):
    from tieout.sources.readers import clean_payroll
    raw = spark.createDataFrame([("a", "b")], "FirstName string, LastName string")
    assert clean_payroll(raw).count() == 0


def test_summary_without_lists_matches(spark, result):
    i, r = result
    cm = clients.unified_matches(i.ledger, i.payroll, i.rules)
    lean = recon.client_summary(cm, i.ledger, i.payroll, i.deposits, with_lists=False)
    assert "employees" not in lean.columns
    a = {(x.client_name, x.qb_balance, x.avi_balance) for x in lean.collect()}
    b = {(x.client_name, x.qb_balance, x.avi_balance) for x in r.summary.collect()}
    assert a == b
    emp_long = recon.client_employees_long(i.payroll)
    assert emp_long.count() == i.payroll.select("bill_to_name", "name").distinct().count()
