"""Aggregates read totals of the cleaned rows in the place of the rows: same results, and nothing written that grows with the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tieout import registry
from tieout.operators import clients, employees, recon
from tieout.sources import readers

LEDGER = [  # cells that clean to the same names, amounts that do not parse, blank types, nulls, repeated rows
    ("Acme:Site 1", "Ann Lee", "1,200.50", "Invoice"), (" Acme--Site 1 ", "Ann Lee ", "-3.00", "Invoice"), ("Acme", "Ann Lee", "7", "Bill"),
    ("Acme", "Ann Lee", "7", "Bill"), ("Acme", "Ann Lee", "n/a", "Credit"), ("Acme", "Bo", "5.25", " "), ("Acme", "Bo", "5.25", None),
    ("Acme", None, "9.10", "Invoice"), (None, "Bo", "2.00", "Invoice"), ("Zeta:", "Cy", None, "Invoice"), ("Zeta", "Cy", "4.00", "Invoice"),
    ("Zeta\n:x", "Cy", "0.01", "Invoice "), ("Only bad", "Di", "x", "Invoice")]
PAYROLL = [
    ("Ann", "Lee", "Acme", "1204.50", "1", "2024-01-03"), ("Ann ", "Lee", " Acme", "-2.00", "0", "2024-01-04"), ("Ann", "Lee", "Acme", "n/a", "1", "2024-01-03"),
    ("Ann", "Lee", "Acme", "8", "n/a", "2024-01-03"), ("Ann", "Lee", "Acme", "8", "1", "never"), (None, "Cy", "DART entities x", "4", "1", "1/2/2024"),
    ("Cy", None, "Dart Entities", "4", "1", "2024-01-03"), ("Cy", None, "Dart Entities", "4", "1", "2024-01-03"), ("Di", "Bad", None, "3", "1", "2024-01-03"),
    ("Ed", "Bad", "Gone", "x", "1", "2024-01-03")]


@pytest.fixture(scope="module")
def both(spark):
    led = spark.createDataFrame(LEDGER, "name string, item string, amount string, type string")
    pay = spark.createDataFrame(PAYROLL, "first_name string, last_name string, bill_to_name string, item_bill string, item_pay string, week_worked string")
    return ((readers.clean_ledger(led), readers.clean_payroll(pay)), (readers.ledger_totals(led), readers.payroll_totals(pay)))


def _same(a, b):
    assert a.dtypes == b.dtypes
    got = [sorted(map(repr, x.collect())) for x in (a, b)]
    assert got[0] == got[1] and got[0]


def test_totals_give_what_the_rows_give(spark, both):
    (led, pay), (led_t, pay_t) = both
    _same(clients.ledger_clients(led, False), clients.ledger_clients(led_t, False))
    _same(clients.payroll_clients(pay, False), clients.payroll_clients(pay_t, False))
    _same(recon.ledger_client_stats(led), recon.ledger_client_stats(led_t))
    _same(recon.payroll_client_stats(pay), recon.payroll_client_stats(pay_t))
    links = spark.createDataFrame([("Acme", "Acme", "Acme"), ("Zeta", "Zeta", "Dart Entities")], "unified_name string, qb_name string, av_name string")
    for x, y in zip(employees.employee_totals(led, pay, links), employees.employee_totals(led_t, pay_t, links), strict=True):
        _same(x, y)
    _same(recon.dashboard_kpis(led, pay, links, links), recon.dashboard_kpis(led_t, pay_t, links, links))


def test_totals_of_extracts_without_rows_or_columns(spark, both):
    (led, pay), _ = both
    bare = spark.createDataFrame([("a",)], "first_name string")
    none = readers.ledger_totals(bare), readers.payroll_totals(bare)
    _same(recon.dashboard_kpis(led.limit(0), pay.limit(0), pay, pay), recon.dashboard_kpis(*none, pay, pay))
    no_amount = spark.createDataFrame([("Acme", "Invoice"), ("Acme", "Invoice"), ("Acme", "")], "name string, type string")
    _same(clients.ledger_clients(readers.clean_ledger(no_amount), False), clients.ledger_clients(readers.ledger_totals(no_amount), False))


def _tables(spark, folder, copies):
    c = spark.range(216).select(F.col("id").alias("c_custkey"))
    o = spark.range(216 * copies).select(F.col("id").alias("o_orderkey"), (F.col("id") % 216).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                                         F.lit(10.0).alias("o_totalprice"), F.lit("5-LOW").alias("o_orderpriority"), F.lit(dt.datetime(1996, 1, 2)).alias("o_orderdate"))
    n = F.lit(1)
    li = o.select(F.col("o_orderkey").alias("l_orderkey"), n.alias("l_linenumber"), (F.col("o_custkey") % 24).alias("l_suppkey"), n.alias("l_partkey"), F.lit(2.5).alias("l_extendedprice"),
                  F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit(1.0).alias("l_quantity"), F.lit(dt.datetime(1996, 1, 2)).alias("l_shipdate"))
    for name, df in (("customer", c), ("orders", o), ("lineitem", li)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_matching_queries_write_nothing_that_grows_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry.clients, "unified_matches", lambda *a: None)
    written = [[t.count() for t in (i.ledger, i.payroll)] for i, _ in
               (registry._match(spark, _tables(spark, tmp_path / str(k), k)) for k in (2, 12))]
    assert written[0] == written[1] and min(written[0]) > 0


def test_totals_of_both_sides_are_written_at_the_same_time(spark):
    """Each job waits for the file of the other: written one after the other, the first would never end well."""
    import os
    import tempfile
    import time

    from tieout.session import cut_lineages
    seen = tempfile.mkdtemp()

    def waits(mine, other):
        def run(batches):
            open(f"{seen}/{mine}", "w").close()
            until = time.time() + 30
            while not os.path.exists(f"{seen}/{other}") and time.time() < until:
                time.sleep(0.05)
            assert os.path.exists(f"{seen}/{other}")
            yield from batches
        return run

    a, b = (spark.range(k, k + 3, numPartitions=1).mapInArrow(waits(x, y), "id long") for k, x, y in ((0, "a", "b"), (10, "b", "a")))
    a, b = cut_lineages(a, b)
    assert sorted(r.id for r in a.collect()) == [0, 1, 2] and sorted(r.id for r in b.collect()) == [10, 11, 12]


def test_short_ways_of_money_and_blank_cells(spark):
    from tieout.functions import text
    cells = [None, "", "~", "~ ", "!", "\x7f", "\x1f", "n/a", "1", " 1 ", "1,200.50", "1e3", "+5", "-.5", "1.005", "12345678901234567", "1,", ",", "1 2", "\u00a01\u2003", "é",
             "a ", "NaN", "0x1", "1d", *text.WS_CHARS, text.WS_CHARS, *(w + "7.5" + w for w in text.WS_CHARS), *(w + "x" for w in text.WS_CHARS)]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    trimmed = text.trim_ws("c")
    long_way = (F.replace(trimmed, F.lit(","), F.lit("")).try_cast("decimal(18,2)"), F.col("c").isNull() | (F.length(trimmed) == 0))
    rows = df.select("c", text.money(F.col("c")).alias("m"), text.is_blank("c").alias("b"), long_way[0].alias("m0"), long_way[1].alias("b0")).collect()
    assert len(rows) == len(cells) and all((r.m, r.b) == (r.m0, r.b0) for r in rows), [r for r in rows if (r.m, r.b) != (r.m0, r.b0)]
