"""

Each query takes ``(spark, sf_dir)``, builds the cleaned fixture inputs from
the driver tables and returns a lazy DataFrame whose columns match the
DuckDB oracle of the same name (``tieout.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .operators import clients, pivots, recon
from .plans.inputs import fixture_inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- 2.1 sources / cleansing ------------------------------------------------------

@query("a1_ledger_clean")
def a1(spark, sf):
    return fixture_inputs(spark, sf).ledger


@query("a2_payroll_clean")
def a2(spark, sf):
    return fixture_inputs(spark, sf).payroll


@query("a3_deposits_clean")
def a3(spark, sf):
    return fixture_inputs(spark, sf).deposits


# --- 2.4 aggregations ---------------------------------------------------------------

@query("b1_ledger_client_item")
def b1(spark, sf):
    return pivots.ledger_client_item(fixture_inputs(spark, sf).ledger)


@query("b2_ledger_rep_client")
def b2(spark, sf):
    return pivots.ledger_rep_client(fixture_inputs(spark, sf).ledger)


@query("b3_ledger_invoices")
def b3(spark, sf):
    return pivots.ledger_invoices(fixture_inputs(spark, sf).ledger)


@query("b4_ledger_employee_job_site")
def b4(spark, sf):
    return pivots.ledger_employee_job_site(fixture_inputs(spark, sf).ledger)


@query("b5_payroll_bill_to_employee")
def b5(spark, sf):
    return pivots.payroll_bill_to_employee(fixture_inputs(spark, sf).payroll)


@query("b6_ledger_client_item_tree")
def b6(spark, sf):
    return pivots.ledger_client_item_tree(fixture_inputs(spark, sf).ledger)


@query("b7_ledger_rep_client_tree")
def b7(spark, sf):
    return pivots.ledger_rep_client_tree(fixture_inputs(spark, sf).ledger)


@query("b8_payroll_bill_to_tree")
def b8(spark, sf):
    return pivots.payroll_bill_to_tree(fixture_inputs(spark, sf).payroll)


# --- 2.3 client matching -------------------------------------------------------------

def _match(spark, sf, rows=False):
    """Inputs and client matches; ``rows`` for queries that show single rows, the others read totals."""
    i = fixture_inputs(spark, sf, materialize=rows, totals=not rows)
    return i, clients.unified_matches(i.ledger, i.payroll, i.rules)


@query("d1_bidirectional_rules")
def d1(spark, sf):
    return clients.bidirectional_rules(fixture_inputs(spark, sf).rules)


@query("d2_best_payroll_client")
def d2(spark, sf):
    i = fixture_inputs(spark, sf)
    lc, pc = clients.ledger_clients(i.ledger), clients.payroll_clients(i.payroll)
    b = clients.best_payroll_client(lc, pc, i.rules)
    return b.select("qb_name", "av_name", "tier", F.round("score", 6).alias("score"))


@query("d3_best_ledger_client")
def d3(spark, sf):
    i = fixture_inputs(spark, sf)
    lc, pc = clients.ledger_clients(i.ledger), clients.payroll_clients(i.payroll)
    return clients.best_ledger_client(lc, pc, i.rules)


@query("d4_unified_matches")
def d4(spark, sf):
    _, cm = _match(spark, sf)
    return cm.matches.select("unified_name", "qb_name", "av_name", "match_type",
                             F.col("qb_total").cast("decimal(18,2)").alias("qb_total"),
                             F.col("av_total").cast("decimal(18,2)").alias("av_total"))


@query("d6_extract_best_client")
def d6(spark, sf):
    i = fixture_inputs(spark, sf)
    lc, pc = clients.ledger_clients(i.ledger), clients.payroll_clients(i.payroll)
    r = clients.extract_best_client(lc, pc, target_col="qb_name", choice_col="av_name", order_cols=("av_o1",))
    return r.withColumn("score", F.round("score", 6))


@query("b14_first_deposit_method")
def b14(spark, sf):
    return recon.first_deposit_method(fixture_inputs(spark, sf).deposits)


def _summary(spark, sf, with_lists=False):
    i, cm = _match(spark, sf)
    return recon.client_summary(cm, i.ledger, i.payroll, i.deposits, with_lists=with_lists)


@query("e1_client_summary")
def e1(spark, sf):
    s = _summary(spark, sf, with_lists=True)
    return (s.withColumn("employees", F.array_join("employees", ", "))
            .withColumn("job_sites", F.array_join("job_sites", ", ")))


# --- employees and variances -----------------------------------------------------------

def _employee_level(spark, sf):
    i, cm = _match(spark, sf)
    emp, cands, assigned = recon.employee_level(cm, i.ledger, i.payroll)
    return i, cm, emp, cands, assigned


@query("d9_best_context_match")
def d9(spark, sf):
    from .operators import employees
    i, cm = _match(spark, sf)
    le, pe = employees.employee_totals(i.ledger, i.payroll, cm.matches)
    top = employees.best_context_match(employees.context_candidates(le, pe))
    return top.select("unified_name", "l_item", "p_name", F.round("composite", 6).alias("composite"),
                      F.round("name_sim", 6).alias("name_sim"))


def _linked_employees(spark, sf):
    """(ledger employees, payroll employees) of the linked clients: unified_name, name, amount and, on the ledger side, ord."""
    from .operators import employees
    i, cm = _match(spark, sf)
    le, pe = employees.employee_totals(i.ledger, i.payroll, cm.matches)
    return (le.select("unified_name", F.col("l_item").alias("name"), F.col("qa").alias("amount"), F.struct("l_o1", "l_item").alias("ord")),
            pe.select("unified_name", F.col("p_name").alias("name"), F.col("pa").alias("amount")))


@query("d7_best_employee")
def d7(spark, sf):
    from .operators import name_index
    best = name_index.best_employee(*_linked_employees(spark, sf))
    return best.select("unified_name", F.col("target").alias("l_item"), "best_match", "tier", F.round("ns", 6).alias("name_sim"))


@query("d8_extract_best_employee")
def d8(spark, sf):
    from .operators import name_index
    best = name_index.extract_best_employee(*_linked_employees(spark, sf))
    return best.select("unified_name", F.col("target").alias("l_item"), "best_match", F.round("score", 6).alias("score"), "reason")


@query("d10_employee_match_table")
def d10(spark, sf):
    from .operators import name_index
    m = name_index.employee_match_table(*_linked_employees(spark, sf))
    return m.select("unified_name", "employee_name", "ledger_name", "payroll_name", F.col("ledger_amount").cast("decimal(18,2)").alias("ledger_amount"),
                    F.col("payroll_amount").cast("decimal(18,2)").alias("payroll_amount"), "emp_match_type")


@query("d13_greedy_assignment")
def d13(spark, sf):
    return _employee_level(spark, sf)[4]


@query("e2_employee_matches")
def e2(spark, sf):
    emp = _employee_level(spark, sf)[2]
    return emp.select("unified_name", "employee_name", "ledger_name", "payroll_name",
                      F.col("ledger_amount").cast("decimal(18,2)").alias("ledger_amount"),
                      F.col("payroll_amount").cast("decimal(18,2)").alias("payroll_amount"), "emp_match_type")


@query("e5_variance_analysis")
def e5(spark, sf):
    i, cm, emp, _, _ = _employee_level(spark, sf)
    return recon.variance_analysis(cm, i.ledger, i.payroll, emp)


# --- remaining cleansing functions ----------------------------------------------------

@query("a12_payroll_week")
def a12(spark, sf):
    from .functions.text import previous_sunday
    p = fixture_inputs(spark, sf).payroll
    return p.select("name", "bill_to_name", "week_worked", previous_sunday("week_worked").alias("week_start"))


@query("a13_payroll_zero_rows")
def a13(spark, sf):
    from .sources.readers import payroll_zero_rows
    return payroll_zero_rows(fixture_inputs(spark, sf).payroll)


@query("a13_payroll_nonzero_rows")
def a13_nonzero(spark, sf):
    from .sources.readers import clean_payroll
    fixture_inputs(spark, sf)
    return clean_payroll(spark.table("f_payroll"), split_zero=True)


PROCESSING_WEEK = "1996-03-13"


@query("a12_processing_week_rows")
def a12_rows(spark, sf):
    from .sources.readers import clean_payroll
    fixture_inputs(spark, sf)
    return clean_payroll(spark.table("f_payroll"), week_of=PROCESSING_WEEK)


@query("a11_payroll_rollup")
def a11(spark, sf):
    from .sources.readers import clean_payroll
    fixture_inputs(spark, sf)
    return clean_payroll(spark.table("f_payroll_text"))


@query("a5_ledger_rejects")
def a5_ledger(spark, sf):
    from .sources.readers import ledger_rejects
    fixture_inputs(spark, sf)
    return ledger_rejects(spark.table("f_ledger"), columns={"amount": "amount_text"}).select(
        "ok", "ln", "name", "item", "type", "amount_text")


@query("a5_payroll_rejects")
def a5_payroll(spark, sf):
    from .sources.readers import payroll_rejects
    fixture_inputs(spark, sf)
    return payroll_rejects(spark.table("f_payroll_text"))


@query("a5_deposit_rejects")
def a5_deposits(spark, sf):
    from .sources.readers import deposit_rejects
    fixture_inputs(spark, sf)
    return deposit_rejects(spark.table("f_deposits"), columns={"amount": "amount_text"})


# --- pivot views and KPIs --------------------------------------------------------------

EXPANDED = ["Harbor Mechanical", "Summit Electric", "Keystone Roofing"]


@query("b9_expanded_view")
def b9(spark, sf):
    t = pivots.ledger_client_item_tree(fixture_inputs(spark, sf).ledger)
    return pivots.expanded_view(t, EXPANDED)


@query("b16_tree_kpis")
def b16(spark, sf):
    return pivots.tree_kpis(pivots.ledger_client_item_tree(fixture_inputs(spark, sf).ledger))


@query("b16_rep_tree_kpis")
def b16_rep(spark, sf):
    return pivots.tree_kpis(pivots.ledger_rep_client_tree(fixture_inputs(spark, sf).ledger))


@query("b16_payroll_tree_kpis")
def b16_payroll(spark, sf):
    return pivots.tree_kpis(pivots.payroll_bill_to_tree(fixture_inputs(spark, sf).payroll))


@query("b16_flat_kpis")
def b16f(spark, sf):
    return pivots.flat_kpis(pivots.ledger_employee_job_site(fixture_inputs(spark, sf).ledger))


@query("b15_dashboard_kpis")
def b15(spark, sf):
    i, cm, emp, _, _ = _employee_level(spark, sf)
    summ = recon.client_summary(cm, i.ledger, i.payroll, i.deposits, with_lists=False)
    var = recon.variance_analysis(cm, i.ledger, i.payroll, emp)
    return recon.dashboard_kpis(i.ledger, i.payroll, summ, var)


# --- scalar function tables ----------------------------------------------------------

@query("c7_client_scores")
def c7(spark, sf):
    from .functions import similarity as S
    from .operators.blocking import client_candidates
    i = fixture_inputs(spark, sf)
    lc, pc = clients.ledger_clients(i.ledger), clients.payroll_clients(i.payroll)
    ls = lc.select(F.col("qb_norm").alias("id"), F.col("qb_norm").alias("s")).distinct()
    ps = pc.select(F.col("av_norm").alias("id"), F.col("av_norm").alias("s")).distinct()
    cand = client_candidates(ls, ps, 0.5)
    a, b = F.col("l"), F.col("r")
    out = cand.select(a.alias("a"), b.alias("b"), F.round(S.lev_ratio(a, b), 6).alias("ratio"),
                      S.first_words_score(a, b).alias("first_words"), S.contains_score(a, b).alias("contains"),
                      S.client_similarity(a, b).alias("sim"), S.client_match_reason(a, b).alias("reason"))
    return out.filter(F.col("sim") >= 0.5).withColumn("similarity", F.round("sim", 6)).drop("sim")


@query("c19_employee_scores")
def c19(spark, sf):
    from .functions import similarity as S
    from .operators import employees
    i, cm = _match(spark, sf)
    le, pe = employees.employee_totals(i.ledger, i.payroll, cm.matches)
    c = employees.context_candidates(le, pe)
    a, b = F.col("l_norm"), F.col("p_norm")
    sc = S.employee_scores(a, b)
    return c.select("unified_name", "l_item", "p_name",
                    F.round(S.ratio(a, b), 6).alias("ratio"), F.round(S.partial_ratio(a, b), 6).alias("partial"),
                    F.round(S.token_sort_ratio(a, b), 6).alias("token_sort"),
                    F.round(S.token_set_ratio(a, b), 6).alias("token_set"),
                    F.round(S.component_similarity(a, b), 6).alias("component"),
                    F.round("name_sim", 6).alias("name_sim"),
                    S.employee_match_reason_from(a, b, sc).alias("reason"),
                    F.round(S.amount_similarity(F.col("qa"), F.col("pa")), 6).alias("amount_sim"),
                    F.round("composite", 6).alias("composite"),
                    employees.employee_type(F.col("l_item"), F.col("p_name")).alias("name_type"))


# --- views -------------------------------------------------------------------------------

def _variances(spark, sf):
    i, cm, emp, _, _ = _employee_level(spark, sf)
    return recon.variance_analysis(cm, i.ledger, i.payroll, emp)


@query("f1_summary_filter")
def f1(spark, sf):
    from .operators import views
    s = _summary(spark, sf)
    return views.filter_summary(s, client_name="an", variance_min=-1000)


@query("f2_variance_filter")
def f2(spark, sf):
    from .operators import views
    return views.filter_variances(_variances(spark, sf), variance_type="employee", variance_min=50,
                                  ledger_amount_min=0)


@query("f3_variance_display")
def f3(spark, sf):
    from .operators import views
    return views.with_display(_variances(spark, sf), money_cols=("ledger_amount", "payroll_amount", "variance"))


@query("f7_annotated_summary")
def f7(spark, sf):
    from .operators import views
    i, cm = _match(spark, sf)
    s = recon.client_summary(cm, i.ledger, i.payroll, i.deposits, with_lists=False)
    return views.with_display(views.annotate(s, i.annotations), money_cols=("variance",))


@query("g5_summary_sorted")
def g5(spark, sf):
    from .operators import views
    return views.sort_summary(_summary(spark, sf), "variance", ascending=False)


@query("g6_variances_sorted")
def g6(spark, sf):
    from .operators import views
    return views.sort_variances(_variances(spark, sf), "variance", ascending=False)


@query("e7_match_trace")
def e7(spark, sf):
    from .operators import trace
    i, cm = _match(spark, sf, rows=True)
    return trace.match_trace(cm, i.ledger, i.payroll, "Okafor")


# --- order lines -----------------------------------------------------------------------

@query("k1_product_ids")
def k1(spark, sf):
    from .operators import orders
    ol = fixture_inputs(spark, sf).order_lines
    return ol.select("order_id", "line_no", orders.product_id("product_link").alias("product_id"))


@query("k2_product_totals")
def k2(spark, sf):
    from .operators import orders
    return orders.product_totals(fixture_inputs(spark, sf).order_lines)


@query("k3_cart_links")
def k3(spark, sf):
    from .operators import orders
    return orders.cart_links(fixture_inputs(spark, sf).order_lines)


@query("k4_line_texts")
def k4(spark, sf):
    from .operators import orders
    return orders.line_texts(fixture_inputs(spark, sf).order_lines)


@query("k5_constraint_violations")
def k5(spark, sf):
    from .operators import orders
    return orders.constraint_violations(fixture_inputs(spark, sf).order_lines)


@query("k5_request_violations")
def k5_requests(spark, sf):
    from .operators import orders
    fixture_inputs(spark, sf)
    return orders.constraint_violations(spark.table("f_requests"))


# --- explicit views of operators that also live inside larger queries ------------------------

@query("a8_a9_client_and_site")
def a8(spark, sf):
    from .functions.text import clean_client_name, job_site, text_cell
    fixture_inputs(spark, sf)
    raw = spark.table("f_ledger").select(text_cell("name").alias("raw_name")).distinct()
    return raw.select("raw_name", clean_client_name("raw_name").alias("client"), job_site("raw_name").alias("site"))


@query("b10_client_totals")
def b10(spark, sf):
    i = fixture_inputs(spark, sf)
    lt = i.ledger.groupBy(F.col("name").alias("client_name")).agg(F.sum("amount").cast("decimal(18,2)").alias("total"))
    pt = i.payroll.groupBy(F.col("bill_to_name").alias("client_name")).agg(
        F.sum("item_bill").cast("decimal(18,2)").alias("total"))
    return lt.withColumn("side", F.lit("ledger")).unionByName(pt.withColumn("side", F.lit("payroll")))


@query("b11_employee_totals")
def b11(spark, sf):
    from .operators import employees
    i, cm = _match(spark, sf)
    le, pe = employees.employee_totals(i.ledger, i.payroll, cm.matches)
    return (le.select("unified_name", F.lit("ledger").alias("side"), F.col("l_item").alias("employee"),
                      F.col("qa").cast("decimal(18,2)").alias("amount"))
            .unionByName(pe.select("unified_name", F.lit("payroll").alias("side"), F.col("p_name").alias("employee"),
                                   F.col("pa").cast("decimal(18,2)").alias("amount"))))


@query("b12_b13_client_stats")
def b12(spark, sf):
    i = fixture_inputs(spark, sf)
    ls = recon.ledger_client_stats(i.ledger).select(
        F.col("name").alias("client_name"), F.lit("ledger").alias("side"), F.col("qb_invoice_count").alias("n"),
        F.array_join(F.coalesce("job_sites", F.array().cast("array<string>")), ", ").alias("distinct_values"))
    ps = recon.payroll_client_stats(i.payroll).select(
        F.col("bill_to_name").alias("client_name"), F.lit("payroll").alias("side"),
        F.col("avionte_record_count").alias("n"), F.array_join("employees", ", ").alias("distinct_values"))
    return ls.unionByName(ps)


@query("d5_match_type_counts")
def d5(spark, sf):
    _, cm = _match(spark, sf)
    return cm.matches.groupBy("match_type").agg(F.count(F.lit(1)).alias("clients"))


@query("d14_payment_types")
def d14(spark, sf):
    return _summary(spark, sf).select("client_name", "avi_client_name", "payment_type", "notes")


@query("e3_client_level_variances")
def e3(spark, sf):
    return _variances(spark, sf).filter(F.col("variance_type") == recon.V_CLIENT)


@query("e4_one_sided_clients")
def e4(spark, sf):
    return _variances(spark, sf).filter(F.col("variance_type").isin(recon.V_LEDGER_CLIENT, recon.V_PAYROLL_CLIENT))


def oracle_sql() -> dict[str, str]:
    from . import oracle
    out: dict[str, str] = {}
    out.update(oracle.pivot_sql())
    out.update(oracle.client_sql())
    out.update(oracle.employee_sql())
    out.update(oracle.name_only_sql())
    out.update(oracle.misc_sql())
    out.update(oracle.explicit_sql())
    return {k: v for k, v in out.items() if k in QUERIES}
