"""D9 candidates by bounds equal scoring every pair, and the bounds hold for every pair."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.functions.similarity import component_similarity, composite_score, name_similarity, partial_ratio, ratio, token_set_ratio, token_sort_ratio
from tieout.operators import amount_join
from tieout.operators.employees import context_candidates

FIRST = ["ann", "Anna", "BOB", "bo", "li", "maria", "marie", "josé", "İpek", "x", "ann ann"]
LAST = ["lee", "Lea", "smith", "smyth", "o neil", "oneil", "garcia lopez", "garcia", "wu", "lee lee", ""]


def employees(rng, n, clients=("a", "b")):
    rows = []
    for _ in range(n):
        w = f"{rng.choice(FIRST)} {rng.choice(LAST)}".split()
        if rng.random() < 0.3:
            rng.shuffle(w)
        amount = rng.choice([Decimal("0.00"), Decimal(rng.randint(-3, 3)), Decimal(rng.randint(-30000, 30000)) / 100, Decimal(rng.randint(1, 300))])
        rows.append((rng.choice(clients), " ".join(w) if rng.random() > 0.05 else "", amount))
    return rows


def sides(spark, n, seed):
    rng = random.Random(seed)
    left = [(c, f"{s}|{i}", s, a, Decimal(i)) for i, (c, s, a) in enumerate(employees(rng, n))]
    right = [(c, f"{s}|{i}", s, a) for i, (c, s, a) in enumerate(employees(rng, n))]
    return (spark.createDataFrame(left, "unified_name string, l_item string, l_norm string, qa decimal(18,2), l_o1 decimal(18,2)"),
            spark.createDataFrame(right, "unified_name string, p_name string, p_norm string, pa decimal(18,2)"))


@pytest.mark.parametrize("cell", [amount_join.PAIRS_PER_CELL, 7])
def test_equals_scoring_every_pair(spark, cell):
    le, pe = sides(spark, 90, 5)
    every = (le.join(pe, "unified_name").withColumn("s", name_similarity(F.col("l_norm"), F.col("p_norm")))
             .withColumn("composite", composite_score(F.col("s"), F.col("qa"), F.col("pa"))).filter("composite >= 0.6"))
    want = {(r.unified_name, r.l_item, r.p_name, round(r.s, 9), round(r.composite, 9)) for r in every.collect()}
    got = [(r.unified_name, r.l_item, r.p_name, round(r.name_sim, 9), round(r.composite, 9)) for r in context_candidates(le, pe, cell).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_bounds_hold_for_every_pair(spark):
    """C15 and its kin never exceed the bounds, over names of few letters (many equal parts, repeated words)."""
    rng = random.Random(11)
    names = {" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) for _ in range(120)}
    le = spark.createDataFrame([("c", s, s, 1.0) for s in names], "unified_name string, l_item string, l_norm string, qa double")
    pe = spark.createDataFrame([("c", s, s, 1.0) for s in names], "unified_name string, p_name string, p_norm string, pa double")
    a, b = F.col("l_norm"), F.col("p_norm")
    met = amount_join.meet(amount_join.profile(le, "l_norm", "qa", "l"), amount_join.profile(pe, "p_norm", "pa", "p"))
    assert met.count() == len(names) ** 2
    letters = F.greatest(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))
    broken = met.filter((letters > amount_join.letters_bound() + 1e-9) | (letters > F.least(amount_join.letters_bound(), amount_join.edits_bound()) + 1e-9)
                        | (partial_ratio(a, b) > amount_join.windows_bound() + 1e-9) | (component_similarity(a, b) > amount_join.words_bound() + 1e-9))
    assert broken.count() == 0


def test_empty_sides(spark):
    le, pe = sides(spark, 20, 3)
    assert context_candidates(le.filter("false"), pe).count() == 0
    assert context_candidates(le, pe.filter("false")).count() == 0
