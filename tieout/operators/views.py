"""Filtered / sorted / annotated views of the results.

Filters are lists of Column predicates AND-ed together, so Catalyst can push
them below the joins that built the summary. Substring filters are literal
and case-insensitive (``instr(lower(c), lower(text)) > 0``): ``%`` and ``_``
are ordinary characters, unlike LIKE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_currency

# Fixed values ------------------------------------------------------------------
STATUSES = ("Complete", "Pending", "Review", "Issue")
MAJOR, MINOR = 100, 10
SUMMARY_SORTS = ("client_name", "qb_balance", "avi_client_name", "avi_balance", "variance", "payment_type",
                 "team", "pr_rep", "send_type", "account_type", "status")
VARIANCE_SORTS = ("client_name", "employee_name", "job_site", "ledger_amount", "payroll_amount", "variance",
                  "variance_type")
# ------------------------------------------------------------------------------


def contains_ci(c: str, text: str) -> Column:
    return F.instr(F.lower(F.col(c)), F.lit(text.lower())) > 0


def _and(preds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None


def filter_summary(df: DataFrame, *, client_name: str = "", avi_client_name: str = "", qb_balance_min=None,
                   avi_balance_min=None, variance_min=None, payment_type: str = "", team: str = "",
                   pr_rep: str = "", send_type: str = "", account_type: str = "", status: str = "") -> DataFrame:
    """every given criterion must hold; empty text / None means 'any'."""
    p = [contains_ci(c, v) for c, v in (("client_name", client_name), ("avi_client_name", avi_client_name),
                                        ("payment_type", payment_type), ("team", team), ("pr_rep", pr_rep),
                                        ("send_type", send_type), ("account_type", account_type)) if v]
    if qb_balance_min is not None:
        p.append(F.col("qb_balance") >= F.lit(qb_balance_min))
    if avi_balance_min is not None:
        p.append(F.col("avi_balance") >= F.lit(avi_balance_min))
    if variance_min is not None:
        p.append(F.abs("variance") >= F.abs(F.lit(variance_min)))
    if status:
        p.append(F.col("status") == status)
    cond = _and(p)
    return df if cond is None else df.filter(cond)


def filter_variances(df: DataFrame, *, client_name: str = "", employee_name: str = "", job_site: str = "",
                     ledger_amount_min=None, payroll_amount_min=None, variance_min=None,
                     variance_type: str = "") -> DataFrame:
    """F2."""
    p = [contains_ci(c, v) for c, v in (("client_name", client_name), ("employee_name", employee_name),
                                        ("job_site", job_site), ("variance_type", variance_type)) if v]
    if ledger_amount_min is not None:
        p.append(F.col("ledger_amount") >= F.lit(ledger_amount_min))
    if payroll_amount_min is not None:
        p.append(F.col("payroll_amount") >= F.lit(payroll_amount_min))
    if variance_min is not None:
        p.append(F.abs("variance") >= F.abs(F.lit(variance_min)))
    cond = _and(p)
    return df if cond is None else df.filter(cond)


def severity(variance: Column) -> Column:
    """|v| > 100 major, > 10 minor, else none."""
    a = F.abs(variance)
    return F.when(a > MAJOR, F.lit("major")).when(a > MINOR, F.lit("minor")).otherwise(F.lit("none"))


def sign_class(variance: Column) -> Column:
    """F4."""
    return (F.when(variance > 0, F.lit("positive")).when(variance < 0, F.lit("negative"))
            .otherwise(F.lit("zero")))


def payment_badge(method: Column) -> Column:
    """F5."""
    return F.when(method == "Check", F.lit("check")).when(method == "ACH", F.lit("ach")).otherwise(F.lit("other"))


def with_display(df: DataFrame, variance: str = "variance", money_cols=()) -> DataFrame:
    """F3-F6 as columns: severity, sign, currency text of the money columns."""
    out = df.withColumn("severity", severity(F.col(variance))).withColumn("sign", sign_class(F.col(variance)))
    if "payment_type" in df.columns:
        out = out.withColumn("payment_badge", payment_badge(F.col("payment_type")))
    for c in money_cols:
        out = out.withColumn(f"{c}_text", format_currency(F.col(c)))
    return out


def annotate(summary: DataFrame, annotations: DataFrame) -> DataFrame:
    """reviewer notes/status per client; notes fall back to the match note,
    a status outside the allowed set is ignored."""
    a = (annotations.groupBy(F.col("client_name").alias("a_client"))
         .agg(F.max("billing_notes").alias("a_billing"), F.max("notes").alias("a_notes"),
              F.max("status").alias("a_status")))
    j = summary.join(a, summary.client_name == a.a_client, "left")
    status = F.when(F.col("a_status").isin(*STATUSES), F.col("a_status")).otherwise(F.col("status"))
    return (j.withColumn("billing_notes", F.coalesce("a_billing", "billing_notes"))
            .withColumn("notes", F.coalesce("a_notes", "notes"))
            .withColumn("status", status)
            .drop("a_client", "a_billing", "a_notes", "a_status"))


def sort_summary(df: DataFrame, column: str | None = None, ascending: bool = True) -> DataFrame:
    """Sort on one whitelisted column (signed variance); the default is the client name."""
    if not column:
        return df.orderBy("client_name")
    if column not in SUMMARY_SORTS:
        raise ValueError(f"cannot sort summary by {column!r}")
    c = F.col(column)
    return df.orderBy(c.asc() if ascending else c.desc())


def sort_variances(df: DataFrame, column: str | None = None, ascending: bool = True) -> DataFrame:
    """Client adds employee as second key; variance sorts on |variance|;
    the default is (client, employee)."""
    if not column:
        return df.orderBy("client_name", "employee_name")
    if column not in VARIANCE_SORTS:
        raise ValueError(f"cannot sort variances by {column!r}")
    keys = {"client_name": [F.col("client_name"), F.col("employee_name")],
            "variance": [F.abs("variance")]}.get(column, [F.col(column)])
    return df.orderBy(*[k.asc() if ascending else k.desc() for k in keys])
