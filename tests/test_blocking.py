"""Blocked candidate generation is lossless: compared with scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tieout.functions.similarity import client_similarity, normalize_client
from tieout.operators.blocking import best_similar, client_candidates, contains_candidates
from tieout.operators.clients import ledger_clients, payroll_clients
from tieout.plans.inputs import fixture_inputs

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def names(spark):
    i = fixture_inputs(spark, SF_SMALL)
    lc = ledger_clients(i.ledger).select(F.col("qb_norm").alias("s")).distinct()
    pc = payroll_clients(i.payroll).select(F.col("av_norm").alias("s")).distinct()
    extra = spark.createDataFrame([("Harbor",), ("Harb",), ("ab",), ("Mech",)], "s string") \
        .select(normalize_client("s").alias("s"))
    return (lc.unionByName(extra).select(F.col("s").alias("id"), "s"),
            pc.select(F.col("s").alias("id"), "s"))


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.75])
def test_client_candidates_lossless(spark, names, threshold):
    left, right = names
    brute = {(r.l, r.r) for r in left.alias("x").crossJoin(right.alias("y"))
             .filter(client_similarity(F.col("x.s"), F.col("y.s")) >= threshold)
             .select(F.col("x.id").alias("l"), F.col("y.id").alias("r")).collect()}
    got = {(r.l, r.r) for r in client_candidates(left, right, threshold).collect()}
    assert brute <= got
    assert len(got) < left.count() * right.count()


def slow_best(left, right, floor):
    """(l, r) with the best score of each left name, by scoring every pair."""
    pairs = (left.alias("x").crossJoin(right.alias("y")).withColumn("score", client_similarity(F.col("x.s"), F.col("y.s")))
             .filter(F.col("score") >= floor).select(F.col("x.id").alias("l"), F.col("y.id").alias("r"), "score").collect())
    top = {}
    for p in pairs:
        top[p.l] = max(top.get(p.l, 0.0), p.score)
    return {(p.l, p.r, round(p.score, 9)) for p in pairs if p.score == top[p.l]}


def best_of(df):
    rows = df.collect()
    top = {}
    for p in rows:
        top[p.l] = max(top.get(p.l, 0.0), p.score)
    return {(p.l, p.r, round(p.score, 9)) for p in rows if p.score == top[p.l]}


@pytest.mark.parametrize("floor", [0.5, 0.7, 0.75, 0.8, 0.9])
def test_staged_join_finds_every_best_pair(spark, names, floor):
    left, right = names
    report = []
    assert best_of(best_similar(left, right, floor, report)) == slow_best(left, right, floor)
    assert [r["threshold"] for r in report][-1] >= floor and all(a["asked"] >= b["asked"] for a, b in zip(report, report[1:]))


def test_staged_join_on_random_names(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    some = lambda n: [(x, x) for x in sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(n)} | {"", "A", "É a", "aaaa aaaa"})]
    left, right = (spark.createDataFrame(some(n), "id string, s string") for n in (90, 130))
    for floor in (0.5, 0.75):
        assert best_of(best_similar(left, right, floor)) == slow_best(left, right, floor)
    assert best_similar(left.limit(0), right, 0.5).count() == 0 and best_similar(left, right.limit(0), 0.5).count() == 0


def test_contains_candidates_short_strings(spark):
    left = spark.createDataFrame([("a", "a"), ("bc", "bc"), ("xyz", "xyz")], "id string, s string")
    right = spark.createDataFrame([("abc", "abc"), ("qq", "qq")], "id string, s string")
    got = {(r.l, r.r) for r in contains_candidates(left, right, min_len=1).collect()}
    assert {("a", "abc"), ("bc", "abc")} <= got


def test_few_names_take_one_stage_and_many_all(spark):
    left, right = (spark.createDataFrame([(x, x) for x in s], "id string, s string") for s in (
        ["Harbor Mechanical", "Summit Electric", "Beacon Paving", "Zq"], ["Harbor Mechanicxal", "Summit Electric LLC", "Paving Beacon", "Beacon Pavings", "Harbor"]))
    few, many = [], []
    one, all_ = best_similar(left, right, 0.5, few), best_similar(left, right, 0.5, many, one_stage_pairs=0)
    assert [r["threshold"] for r in few] == [0.5] and len(many) > 1
    assert best_of(one) == best_of(all_) == slow_best(left, right, 0.5)
