"""Client summary and the per-client aggregates around it.

The summary is the D4 match table left-joined to per-client aggregates of
each side: every join is on a client name against a table with one row per
client, so the only row-level work is the map-side-combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clients import NO_PAYMENT_METHOD, ClientMatch, match_notes
from .totals import least_amount, row_count, summed


def first_deposit_method(deposits: DataFrame) -> DataFrame:
    """Payment method of each client's first deposit row (file order)."""
    return (deposits.groupBy("client_name")
            .agg(F.min_by("payment_method", "row_idx").alias("payment_method")))


def ledger_client_stats(ledger: DataFrame, with_lists: bool = True) -> DataFrame:
    """B10/B12/B13 ledger side: total, distinct types, job sites in entry order."""
    base = ledger.groupBy("name").agg(summed(ledger, "amount").alias("qb_balance"),
                                      F.countDistinct("type").alias("qb_invoice_count"))
    if not with_lists:
        return base
    sites = (ledger.filter(F.col("memo") != "")
             .groupBy("name", "memo").agg(F.min(F.struct(least_amount(ledger), "item")).alias("o"))
             .groupBy("name")
             .agg(F.sort_array(F.collect_list(F.struct("o", "memo"))).alias("s"))
             .select("name", F.transform("s", lambda x: x["memo"]).alias("job_sites")))
    return base.join(sites, "name", "left")


def payroll_client_stats(payroll: DataFrame, with_lists: bool = True) -> DataFrame:
    """B10/B12/B13 payroll side: total, row count, distinct employees by name."""
    base = payroll.groupBy("bill_to_name").agg(summed(payroll, "item_bill").alias("avi_balance"),
                                               row_count(payroll).alias("avionte_record_count"))
    if not with_lists:
        return base
    emps = (payroll.select("bill_to_name", "name").distinct()
            .groupBy("bill_to_name").agg(F.sort_array(F.collect_list("name")).alias("employees")))
    return base.join(emps, "bill_to_name", "left")


def _nonempty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def client_employees_long(payroll: DataFrame) -> DataFrame:
    """B12 long form: one row per (payroll client, distinct employee) - no collection."""
    return payroll.select(F.col("bill_to_name").alias("client_name"), F.col("name").alias("employee")).distinct()


def client_job_sites_long(ledger: DataFrame) -> DataFrame:
    """B12 long form: one row per (ledger client, distinct non-empty job site) with its entry order."""
    return (ledger.filter(F.col("memo") != "").groupBy(F.col("name").alias("client_name"), F.col("memo").alias("job_site"))
            .agg(F.min(F.struct(least_amount(ledger), "item")).alias("first_seen")))


def client_summary(cm: ClientMatch, ledger: DataFrame, payroll: DataFrame, deposits: DataFrame | None,
                   with_lists: bool = True) -> DataFrame:
    """E1 + D14 + D15: one row per unified client, ordered by ``client_name`` at output.

    ``with_lists`` adds the source's per-client ``employees`` / ``job_sites``
    arrays (distinct values, built from pre-aggregated keys). For clients with
    very many distinct employees use ``with_lists=False`` and the long forms
    :func:`client_employees_long` / :func:`client_job_sites_long` instead."""
    m = cm.matches
    ls = ledger_client_stats(ledger, with_lists).withColumnRenamed("name", "ls_name")
    ps = payroll_client_stats(payroll, with_lists).withColumnRenamed("bill_to_name", "ps_name")
    s = (m.join(ls, _nonempty("qb_name") & (F.col("qb_name") == F.col("ls_name")), "left")
         .join(ps, _nonempty("av_name") & (F.col("av_name") == F.col("ps_name")), "left"))
    pay = F.lit(NO_PAYMENT_METHOD)
    if deposits is not None:
        dq = first_deposit_method(deposits).select(F.col("client_name").alias("dq_name"),
                                                   F.col("payment_method").alias("pm_q"))
        da = dq.select(F.col("dq_name").alias("da_name"), F.col("pm_q").alias("pm_a"))
        s = (s.join(dq, _nonempty("qb_name") & (F.col("qb_name") == F.col("dq_name")), "left")
             .join(da, _nonempty("av_name") & (F.col("av_name") == F.col("da_name")), "left"))
        pay = F.coalesce("pm_q", "pm_a", pay)
    zero = F.lit(0).cast("decimal(18,2)")
    qb_bal = F.coalesce(F.col("qb_balance").cast("decimal(18,2)"), zero)
    av_bal = F.coalesce(F.col("avi_balance").cast("decimal(18,2)"), zero)
    return s.select(
        F.coalesce("qb_name", "unified_name").alias("client_name"), qb_bal.alias("qb_balance"),
        F.coalesce("av_name", F.lit("")).alias("avi_client_name"), av_bal.alias("avi_balance"),
        (qb_bal - av_bal).cast("decimal(18,2)").alias("variance"), pay.alias("payment_type"),
        F.lit("").alias("team"), F.lit("").alias("pr_rep"), F.lit("").alias("send_type"),
        F.lit("").alias("account_type"), F.lit("").alias("billing_notes"),
        match_notes(F.col("match_type")).alias("notes"), F.lit("").alias("status"),
        F.coalesce("qb_invoice_count", F.lit(0)).cast("long").alias("qb_invoice_count"),
        F.coalesce("avionte_record_count", F.lit(0)).cast("long").alias("payroll_record_count"),
        *([F.coalesce("employees", F.array().cast("array<string>")).alias("employees"),
           F.coalesce("job_sites", F.array().cast("array<string>")).alias("job_sites")] if with_lists else []),
        "match_type", "unified_name")


def dashboard_kpis(ledger: DataFrame, payroll: DataFrame, summary: DataFrame, variances: DataFrame) -> DataFrame:
    """Record counts, client count and variance count in one row."""
    one = F.lit(1)
    return ledger.agg(row_count(ledger).alias("ledger_records")).select(
        "ledger_records",
        payroll.agg(row_count(payroll)).scalar().alias("payroll_records"),
        summary.agg(F.count(one)).scalar().alias("clients"),
        variances.agg(F.count(one)).scalar().alias("variances"))


# --- variance analysis (E2-E5) -------------------------------------------------------

# Variance types and note texts (side names neutral: ledger/payroll).
V_LEDGER_EMP, V_PAYROLL_EMP, V_AMOUNT = "Ledger Only Employee", "Payroll Only Employee", "Employee Amount Variance"
V_CLIENT, V_LEDGER_CLIENT, V_PAYROLL_CLIENT = "Client Level Variance", "Ledger Only Client", "Payroll Only Client"


def employee_level(cm: ClientMatch, ledger: DataFrame, payroll: DataFrame):
    """Employee totals, candidates, greedy assignment and final employee matches."""
    from .employees import context_candidates, employee_matches, employee_totals, greedy_assignment
    le, pe = employee_totals(ledger, payroll, cm.matches)
    cands = context_candidates(le, pe)
    assigned = greedy_assignment(cands)
    return employee_matches(le, pe, assigned), cands, assigned


def variance_analysis(cm: ClientMatch, ledger: DataFrame, payroll: DataFrame, emp: DataFrame | None = None) -> DataFrame:
    """E5 = E2 (employee rows) + E3 (unexplained client variance) + E4 (one-sided clients)."""
    from ..functions.text import format_currency, format_n2
    if emp is None:
        emp = employee_level(cm, ledger, payroll)[0]
    qa, pa = F.col("ledger_amount"), F.col("payroll_amount")
    sig = F.abs(qa - pa) > 0.01
    zero = (F.abs(F.abs(qa) - F.abs(pa)) < 0.01) & (F.abs(qa + pa) < 0.01)
    et = F.col("emp_match_type")
    e2 = (emp.filter(sig & ~((et != "LedgerOnly") & (et != "PayrollOnly") & zero))
          .select(F.col("unified_name").alias("client_name"), "employee_name", F.lit("Multiple").alias("job_site"),
                  qa.alias("ledger_amount"), pa.alias("payroll_amount"),
                  F.when(et == "LedgerOnly", F.lit(V_LEDGER_EMP)).when(et == "PayrollOnly", F.lit(V_PAYROLL_EMP))
                  .otherwise(F.lit(V_AMOUNT)).alias("variance_type"),
                  F.when(et == "LedgerOnly", F.concat(F.lit("Employee exists only in the ledger for client "),
                                                      F.col("unified_name")))
                  .when(et == "PayrollOnly", F.concat(F.lit("Employee exists only in payroll for client "),
                                                      F.col("unified_name")))
                  .otherwise(F.concat(F.lit("Employee amounts differ: ledger $"), format_n2(qa),
                                      F.lit(" vs payroll $"), format_n2(pa), F.lit(" (Match: "), et, F.lit(")")))
                  .alias("notes")))
    perfect = (F.coalesce(F.col("ledger_name"), F.lit("")) != "") & (F.coalesce(F.col("payroll_name"), F.lit("")) != "")
    per_client = emp.groupBy("unified_name").agg(
        F.sum(F.when(perfect & ~zero, qa - pa).otherwise(F.lit(0))).alias("matched_var"),
        F.sum(F.when(~perfect, qa - pa).otherwise(F.lit(0))).alias("unmatched_var"))
    linked = with_flags_linked(cm.matches)
    e3 = (linked.join(per_client, "unified_name", "left")
          .withColumn("cv", F.col("qb_total") - F.col("av_total"))
          .withColumn("unexplained", F.col("cv") - (F.coalesce("matched_var", F.lit(0))
                                                    + F.coalesce("unmatched_var", F.lit(0))))
          .filter((F.abs("cv") > 0.01) & (F.abs("unexplained") > 0.01))
          .select(F.col("unified_name").alias("client_name"), F.lit("Client Total").alias("employee_name"),
                  F.lit("All").alias("job_site"), F.col("qb_total").alias("ledger_amount"),
                  F.col("av_total").alias("payroll_amount"), F.lit(V_CLIENT).alias("variance_type"),
                  F.concat(F.lit("Client total variance: "), format_currency(F.col("cv")), F.lit(" (Match: "),
                           F.col("match_type"), F.lit(") - Unexplained: "), format_currency(F.col("unexplained")))
                  .alias("notes")))
    m = cm.matches
    e4 = (m.filter(F.col("match_type").isin("LedgerOnly", "PayrollOnly"))
          .select(F.when(F.col("match_type") == "LedgerOnly", F.col("qb_name")).otherwise(F.col("av_name"))
                  .alias("client_name"), F.lit("Total").alias("employee_name"), F.lit("All").alias("job_site"),
                  F.when(F.col("match_type") == "LedgerOnly", F.col("qb_total")).otherwise(F.lit(0))
                  .alias("ledger_amount"),
                  F.when(F.col("match_type") == "PayrollOnly", F.col("av_total")).otherwise(F.lit(0))
                  .alias("payroll_amount"),
                  F.when(F.col("match_type") == "LedgerOnly", F.lit(V_LEDGER_CLIENT))
                  .otherwise(F.lit(V_PAYROLL_CLIENT)).alias("variance_type"),
                  F.when(F.col("match_type") == "LedgerOnly", F.lit("Client exists only in the ledger"))
                  .otherwise(F.lit("Client exists only in payroll")).alias("notes")))
    out = e2.unionByName(e3).unionByName(e4)
    return out.select("client_name", "employee_name", "job_site",
                      F.col("ledger_amount").cast("decimal(18,2)").alias("ledger_amount"),
                      F.col("payroll_amount").cast("decimal(18,2)").alias("payroll_amount"),
                      (F.col("ledger_amount") - F.col("payroll_amount")).cast("decimal(18,2)").alias("variance"),
                      "variance_type", "notes")


def with_flags_linked(matches: DataFrame) -> DataFrame:
    from .clients import with_flags
    return with_flags(matches).filter("is_linked")
