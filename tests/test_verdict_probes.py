"""Cases that a review found wrong: each fails on the code before."""

import pytest
from pyspark.sql import functions as F

from tieout.operators import employees, pivots, views
from tieout.operators.orders import constraint_violations
from tieout.sources import readers


def test_greedy_guard_raises_and_chains_end(spark):
    """A chain of competing employees needs a round each; a guard below that raises instead of dropping the rest."""
    rows = []
    for i in range(5):
        rows += [("c", f"l{i}", float(i), f"p{j}", r + 1) for r, j in enumerate(range(min(i + 1, 5)))]
    cands = spark.createDataFrame(rows, "unified_name string, l_item string, l_o1 double, p_name string, rank int")
    got = {(r["l_item"], r["p_name"]) for r in employees.greedy_assignment(cands, fold_edges=0).collect()}
    assert got == {(f"l{i}", f"p{i}") for i in range(5)}
    with pytest.raises(RuntimeError):
        employees.greedy_assignment(cands, fold_edges=0, max_rounds=2)


def _name_only(spark, client, ledger, payroll):
    pairs = [(client, a, b, i) for a in ledger for i, b in enumerate(payroll)]
    return employees.name_only_matches(
        spark.createDataFrame(pairs, "unified_name string, target string, choice string, choice_ord int"),
        spark.createDataFrame([(client, n, 1.0, i) for i, n in enumerate(ledger)], "unified_name string, name string, amount double, ord int"),
        spark.createDataFrame([(client, n, 2.0) for n in payroll], "unified_name string, name string, amount double")).collect()


def test_name_only_scores_bare_names(spark):
    got = {r["employee_name"]: r for r in _name_only(spark, "Harbor Mechanical Services", ["Ann Lee"], ["Ann", "Ann Lee"])}
    assert got["Ann Lee"]["payroll_name"] == "Ann Lee" and got["Ann Lee"]["emp_match_type"] == employees.EXACT
    assert got["Ann"]["emp_match_type"] == employees.PAYROLL_ONLY
    got = _name_only(spark, "Mercy Health", ["Bo Wu"], ["Mercy Heath"])
    assert {r["emp_match_type"] for r in got} == {employees.LEDGER_ONLY, employees.PAYROLL_ONLY}


def test_groups_do_not_mix(spark):
    pairs = spark.createDataFrame([("a", "Ann Lee", "Bo Wu", 1), ("b", "Ann Lee", "Ann Lee", 1)],
                                  "g string, target string, choice string, choice_ord int")
    got = [(r["g"], r["best_match"]) for r in employees.best_by_name(pairs, group="g").collect()]
    assert got == [("b", "Ann Lee")]
    got = {r["g"]: r["best_match"] for r in employees.extract_best_by_name(pairs, group="g").collect()}
    assert got == {"a": None, "b": "Ann Lee"}


def test_last_write_wins_by_number(spark):
    """Order 10 comes after 9, not before it as in text order."""
    pairs = spark.createDataFrame([("c", "x", "y", 1)], "unified_name string, target string, choice string, choice_ord int").filter("false")
    led = spark.createDataFrame([("c", "ANN", 1.0, 9), ("c", "Ann", 2.0, 10)], "unified_name string, name string, amount double, ord int")
    pay = spark.createDataFrame([], "unified_name string, name string, amount double")
    assert [r["ledger_amount"] for r in employees.name_only_matches(pairs, led, pay).collect()] == [2.0]


def test_duplicate_header_keeps_last_column(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Type,Name,Amount,Item,Amount\nInvoice,Acme,1.00,Ann,7.50\n")
    assert [float(r["amount"]) for r in readers.read_ledger(spark, str(tmp_path / "l.csv")).collect()] == [7.5]


def test_thousands_and_local_dates(spark, tmp_path):
    (tmp_path / "p.csv").write_text('FirstName,LastName,Bill To Name,Item Bill,Item Pay,Week Worked\n'
                                    'Ann,Lee,Acme,"1,200.00",9,3/6/2024\nBo,Wu,Acme,x,1,2024-03-06\n')
    got = readers.read_payroll(spark, str(tmp_path / "p.csv")).collect()
    assert [(float(r["item_bill"]), str(r["week_worked"])) for r in got] == [(1200.0, "2024-03-06")]
    raw = spark.read.option("header", True).csv(str(tmp_path / "p.csv"))
    assert [r["FirstName"] for r in readers.payroll_rejects(raw).collect()] == ["Bo"]


def test_deposits_of_several_files_keep_file_order(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "1.csv").write_text("Type,Name,Num,Amount,Date\nDeposit,Acme,17,1.00,2024-01-01\n")
    (folder / "2.csv").write_text("Type,Name,Num,Amount,Date\n" + "Deposit,Acme,,2.00,2024-01-02\n" * 500 + "Deposit,Acme,,bad,2024-01-02\nDeposit,Late,,1,2024-01-03\n")
    got = readers.read_deposits(spark, str(folder))
    first = got.groupBy("client_name").agg(F.min(F.struct("row_idx", "payment_method"))["payment_method"].alias("m")).collect()
    assert [(r["client_name"], r["m"]) for r in first] == [("Acme", "Check")] and got.count() == 501
    raw = spark.read.option("header", True).csv(str(folder))
    assert readers.deposit_rejects(raw).count() == 1
    out = str(tmp_path / "q")
    spark.read.option("header", True).csv(str(folder / "1.csv")).write.parquet(out)
    assert readers.read_deposits(spark, out, "parquet").schema["row_idx"].dataType == got.schema["row_idx"].dataType


def test_empty_extract_raises(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    for read in (readers.read_ledger, readers.read_payroll):
        with pytest.raises(Exception):
            read(spark, str(tmp_path / "e.csv"))


def test_requester_fields_are_required(spark):
    lines = spark.createDataFrame([(1, 1, "x", "y", 1, None, "n", " ")], "order_id int, line_no int, product_link string, ship_to string, "
                                  "quantity int, email string, name string, department string")
    assert sorted(r["rule"] for r in constraint_violations(lines).collect()) == ["department required", "email required"]


def test_scratch_needs_a_shared_folder(spark):
    from tieout.session import cut_lineage, delete_path, scratch_path
    path = scratch_path(spark)
    spark.range(3).write.parquet(path)
    delete_path(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    assert cut_lineage(spark.range(3)).count() == 3


def test_default_and_chosen_orders(spark):
    """The order of the rows, which a comparison of sorted values cannot see."""
    s = spark.createDataFrame([("b", -5.0), ("c", 1.0), ("a", 3.0)], "client_name string, variance double")
    assert [r[0] for r in views.sort_summary(s).collect()] == ["a", "b", "c"]
    assert [r[0] for r in views.sort_summary(s, "variance", ascending=False).collect()] == ["a", "c", "b"]
    v = spark.createDataFrame([("b", "y", 1.0), ("a", "z", -7.0), ("a", "x", 3.0)], "client_name string, employee_name string, variance double")
    assert [r[1] for r in views.sort_variances(v).collect()] == ["x", "z", "y"]
    assert [r[1] for r in views.sort_variances(v, "variance", ascending=False).collect()] == ["z", "x", "y"]
    t = spark.createDataFrame([("g2", "item", "a"), ("g1", "item", "z"), ("g1", "group", "g1"), ("g2", "group", "g2"), ("g1", "item", "b")],
                              "group_name string, level string, key string")
    assert [r["key"] for r in pivots.sorted_tree(t).collect()] == ["g1", "b", "z", "g2", "a"]
