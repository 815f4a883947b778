"""CSV sources with the source extracts' headers."""

from tieout.sources.readers import read_ledger, read_payroll


def test_ledger_csv_headers(spark, tmp_path):
    p = tmp_path / "ledger.csv"
    p.write_text("Type,Name,Item,Amount, Rep ,P. O. #,Balance\n"
                 "Invoice,Acme--Site 4,Ann Lee,12.50,R1,77,1\n"
                 ",Total,,99.00,,,\n"
                 "Invoice,Beta:Dock,Bo Wu,n/a,R2,78,2\n"
                 "Invoice,Gamma,Cy Po,3,,,\n")
    rows = sorted(tuple(r) for r in read_ledger(spark, str(p)).collect())
    assert rows == [("Acme", "Site 4", "Ann Lee", 12.5, "Invoice", "", "R1", "77"),
                    ("Gamma", "Gamma", "Cy Po", 3, "Invoice", "", "", "")]


def test_ledger_without_type_is_empty(spark, tmp_path):
    p = tmp_path / "noType.csv"
    p.write_text("Name,Amount\nAcme,1.00\n")
    assert read_ledger(spark, str(p)).count() == 0


def test_payroll_csv_and_prefix_rollup(spark, tmp_path):
    p = tmp_path / "payroll.csv"
    p.write_text("FirstName,LastName,Bill To Name,Item Bill,Item Pay,Week Worked\n"
                 " Ann , Lee ,dart entities west,10.00,9.00,2024-03-06\n"
                 "Bo,Wu,Beta,x,1,2024-03-06\n")
    rows = [tuple(r) for r in read_payroll(spark, str(p)).collect()]
    assert len(rows) == 1 and rows[0][0] == "Ann Lee" and rows[0][1] == "Dart Entities"
    wk = read_payroll(spark, str(p), week_of="2024-03-09").count()
    assert wk == 1 and read_payroll(spark, str(p), week_of="2024-03-11").count() == 0


def test_batch_job_end_to_end(spark, tmp_path):
    from tieout.plans.run import main
    (tmp_path / "l.csv").write_text(
        "Type,Name,Item,Amount,Rep\nInvoice,Acme Roofing:North,Ann Lee,100.00,R1\n"
        "Invoice,Acme Roofing--South,Bo Wu,50.00,R1\nInvoice,Zeta Corp,Cy Po,10.00,\n")
    (tmp_path / "p.csv").write_text(
        "FirstName,LastName,Bill To Name,Item Bill,Item Pay,Week Worked\n"
        "Ann,Lee,ACME ROOFING,100.00,90.00,2024-03-06\nBo,Wu,ACME ROOFING,45.00,40.00,2024-03-06\n"
        "Di,Ng,Omega LLC,7.00,6.00,2024-03-06\n")
    (tmp_path / "d.csv").write_text("Type,Name,Num,Amount,Date\nDeposit,Acme Roofing,1001,150.00,2024-03-07\n")
    out = tmp_path / "out"
    main(["--ledger", str(tmp_path / "l.csv"), "--payroll", str(tmp_path / "p.csv"),
          "--deposits", str(tmp_path / "d.csv"), "--out", str(out)])
    s = {r.client_name: r for r in spark.read.parquet(str(out / "summary")).collect()}
    assert s["Acme Roofing"].avi_client_name == "ACME ROOFING" and s["Acme Roofing"].payment_type == "Check"
    v = {(r.client_name, r.employee_name, r.variance_type) for r in spark.read.parquet(str(out / "variances")).collect()}
    assert ("Acme Roofing", "Bo Wu", "Employee Amount Variance") in v
    assert ("Zeta Corp", "Total", "Ledger Only Client") in v and ("Omega LLC", "Total", "Payroll Only Client") in v
