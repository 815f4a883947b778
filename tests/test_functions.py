"""Scalar functions against the demo vectors (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from tieout.functions import similarity as S
from tieout.functions import text as T
from tieout.operators import employees

CANDIDATES = ["Antonio Mendez Morillo", "Hector Vizcaya Daza", "Juan Rodriguez Salas", "Ricardo Mendez Morillo"]

VECTORS = [
    # target, best, ratio, partial, sort, set, component
    ("Antonio Mendez", "Antonio Mendez Morillo", 0.6364, 1.0, 0.6364, 0.6364, 0.95),
    ("Hector Vizcaya", "Hector Vizcaya Daza", 0.7368, 1.0, 0.7368, 0.7368, 0.95),
    ("Juan Rodriguez", "Juan Rodriguez Salas", 0.7, 1.0, 0.7, 0.7, 0.95),
    ("Ricardo Mendez Diaz", "Ricardo Mendez Morillo", 0.7273, 0.7895, 0.5, 0.7273, 0.5714),
    ("Alfonso Anguiano Saucedo", "Alfonzo Anguiano Saucedo", 0.9583, 0.9583, 0.9583, 0.9583, 0.9286),
]


def _one(spark, a, b, *cols):
    return spark.createDataFrame([(a, b)], "a string, b string").select(*cols).first()


@pytest.mark.parametrize("target,best,ratio,partial,srt,st,comp", VECTORS)
def test_employee_measures(spark, target, best, ratio, partial, srt, st, comp):
    a, b = S.normalize_employee(F.col("a")), S.normalize_employee(F.col("b"))
    r = _one(spark, target, best, S.ratio(a, b).alias("r"), S.partial_ratio(a, b).alias("p"),
             S.token_sort_ratio(a, b).alias("s"), S.token_set_ratio(a, b).alias("t"),
             S.component_similarity(a, b).alias("c"), S.name_similarity(a, b).alias("n"))
    assert r.r == pytest.approx(ratio, abs=1e-4)
    assert r.p == pytest.approx(partial, abs=1e-4)
    assert r.s == pytest.approx(srt, abs=1e-4)
    assert r.t == pytest.approx(st, abs=1e-4)
    assert r.c == pytest.approx(comp, abs=1e-4)
    assert 0.0 <= r.n <= 1.0


def _pairs(spark, targets, choices):
    rows = [(t, c, i) for t in targets for i, c in enumerate(choices)]
    return spark.createDataFrame(rows, "target string, choice string, choice_ord int")


def test_best_by_name_tiers(spark):
    got = {r.target: r.best_match for r in employees.best_by_name(
        _pairs(spark, [v[0] for v in VECTORS[:4]], CANDIDATES)).collect()}
    assert got == {v[0]: v[1] for v in VECTORS[:4]}


def test_extract_best_by_name(spark):
    out = {r.target: r for r in employees.extract_best_by_name(
        _pairs(spark, [v[0] for v in VECTORS[:4]], CANDIDATES), threshold=0.8).collect()}
    assert out["Antonio Mendez"].score == pytest.approx(1.0)
    assert out["Antonio Mendez"].reason == "Partial match (100%)"
    assert out["Ricardo Mendez Diaz"].best_match is None
    assert out["Ricardo Mendez Diaz"].reason == "No match above 80% threshold"
    low = {r.target: r for r in employees.extract_best_by_name(
        _pairs(spark, ["Ricardo Mendez Diaz"], CANDIDATES), threshold=0.7).collect()}
    assert low["Ricardo Mendez Diaz"].score == pytest.approx(0.789474, abs=1e-6)
    pair = _pairs(spark, ["Alfonso Anguiano Saucedo"], ["Alfonzo Anguiano Saucedo", "Maria Lopez", "Jose Ruiz"])
    r = employees.extract_best_by_name(pair, threshold=0.6).first()
    assert r.score == pytest.approx(0.958333, abs=1e-6) and r.reason.startswith("Basic similarity")


@pytest.mark.parametrize("raw,client,site", [("A--B:C", "A", "C"), ("A:B--C", "A", "C"), ("Acme", "Acme", "Acme"),
                                             ("a---b", "a", "-b")])
def test_clean_name_and_site(spark, raw, client, site):
    r = spark.createDataFrame([(raw,)], "n string").select(T.clean_client_name("n").alias("c"),
                                                          T.job_site("n").alias("s")).first()
    assert (r.c, r.s) == (client, site)


def test_normalize_client_and_trim(spark):
    r = spark.createDataFrame([("Foo Inc. & Co", "\t x  ", "Harbor Mechanical, LLC")], "a string, b string, c string") \
        .select(S.normalize_client("a").alias("a"), T.trim_ws("b").alias("b"), S.normalize_client("c").alias("c")).first()
    assert r.a == "Foo" and r.b == "x" and r.c == "Harbor Mechanical"


def test_client_similarity_parts(spark):
    r = _one(spark, "Harbor Mechanical", "Harbor Mechanical Holdings Group",
             S.client_similarity("a", "b").alias("s"), S.client_match_reason("a", "b").alias("m"))
    assert r.s == pytest.approx(0.85) and r.m == "First words match (85%)"
    assert _one(spark, "", "x", S.client_similarity("a", "b").alias("s")).s == 0.0


def test_amounts(spark):
    r = spark.createDataFrame([(100.0, 40.0), (0.0, 0.0), (5.0, 0.0), (10.0, -10.0)], "a double, b double") \
        .select(S.amount_similarity(F.col("a").cast("decimal(18,2)"), F.col("b").cast("decimal(18,2)")).alias("s"),
                S.amounts_zero_out(F.col("a").cast("decimal(18,2)"), F.col("b").cast("decimal(18,2)")).alias("z")) \
        .collect()
    assert [x.s for x in r] == [pytest.approx(0.4), 1.0, 0.0, 0.0]
    assert [x.z for x in r] == [False, True, False, True]


def test_previous_sunday(spark):
    r = spark.createDataFrame([("2026-12-01",), ("2026-11-29",)], "d string") \
        .select(T.previous_sunday(F.col("d").cast("date")).cast("string").alias("w")).collect()
    assert [x.w for x in r] == ["2026-11-29", "2026-11-29"]


def test_product_id(spark):
    from tieout.operators.orders import product_id
    rows = [("https://x.com/a/dp/B00ABCDEFG/ref",), ("https://x.com/gp/aw/d/b00abcdefg",),
            ("https://x.com/i?q=1&ASIN=B00ABCDEFG",), ("https://x.com/search?q=B00ABCDEFG",), ("  ",)]
    got = [r.p for r in spark.createDataFrame(rows, "u string").select(product_id("u").alias("p")).collect()]
    assert got == ["B00ABCDEFG", "B00ABCDEFG", "B00ABCDEFG", None, None]


def test_name_only_matches(spark):
    pairs = spark.createDataFrame(
        [("c", t, ch, i) for t in ["Antonio Mendez", "Zed Qux"] for i, ch in enumerate(CANDIDATES)],
        "unified_name string, target string, choice string, choice_ord int")
    led = spark.createDataFrame([("c", "Antonio Mendez", 10.0, 1), ("c", "Zed Qux", 5.0, 2)],
                                "unified_name string, name string, amount double, ord int")
    pay = spark.createDataFrame([("c", n, 1.0) for n in CANDIDATES], "unified_name string, name string, amount double")
    out = {r.employee_name: r for r in employees.name_only_matches(pairs, led, pay).collect()}
    assert out["Antonio Mendez"].payroll_name == "Antonio Mendez Morillo"
    assert out["Antonio Mendez"].emp_match_type == "NameComponents"
    assert out["Zed Qux"].emp_match_type == "LedgerOnly"
    assert out["Hector Vizcaya Daza"].emp_match_type == "PayrollOnly"
    assert "Antonio Mendez Morillo" not in out
