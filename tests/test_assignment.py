"""The assignment equals the sequential fold whichever way it goes: whole clients, contention components, or rounds."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.operators.employees import connected_parts, greedy_assignment


def slow_assignment(rows):
    used, out = set(), set()
    who = {}
    for client, item, o1, name, rank in rows:
        who.setdefault((client, o1, item), []).append((rank, name))
    for client, o1, item in sorted(who):
        for _, name in sorted(who[client, o1, item]):
            if (client, name.lower()) not in used:
                used.add((client, name.lower()))
                out.add((client, item, name))
                break
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "unified_name string, l_item string, l_o1 decimal(18,2), p_name string, rank int")


def random_rows(rng, client, n, m, most):
    rows = []
    for i in range(n):
        o1 = Decimal(rng.randrange(50)) / 2
        chosen = rng.sample(range(m), rng.randint(0, min(m, most)))
        rows += [(client, f"l{i}", o1, f"{rng.choice('pP')}{j}", r + 1) for r, j in enumerate(chosen)]
    return rows


@pytest.mark.parametrize("fold_edges", [100_000, 40, 3])
def test_equals_the_fold(spark, fold_edges):
    rng = random.Random(fold_edges)
    rows = random_rows(rng, "dense", 25, 15, 6) + random_rows(rng, "sparse", 60, 90, 2) + random_rows(rng, "small", 4, 3, 2)
    assert {tuple(r) for r in greedy_assignment(frame(spark, rows), fold_edges).collect()} == slow_assignment(rows)


@pytest.mark.parametrize("fold_edges,jobs", [(100_000, 20), (1500, 300)])
def test_chains_of_competitors_take_a_bounded_number_of_jobs(spark, fold_edges, jobs):
    """Each wants what the one before got: as many rounds as competitors if it went by rounds. One chain of 1000 and two of 500 in clients
    of 2000 candidates; with the smaller bound the second client is split into its components first."""
    chain = lambda client, start, n: [(client, f"l{i:04}", Decimal(i), f"p{j:04}", r) for i in range(start, start + n) for r, j in ((1, max(start, i - 1)), (2, i))]
    rows = chain("c", 0, 1000) if fold_edges > 2000 else []
    rows += chain("e", 0, 500) + chain("e", 500, 500) + [("d", "x", Decimal(1), "y", 1)]
    spark.sparkContext.setJobGroup(f"chain-{fold_edges}", "chain")
    got = {tuple(r) for r in greedy_assignment(frame(spark, rows), fold_edges).collect()}
    made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{fold_edges}"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got == slow_assignment(rows) and made < jobs


def test_components_of_a_long_path_in_few_rounds(spark):
    rng = random.Random(1)
    names = rng.sample(range(10 ** 6), 1200)
    edges = [(names[i], names[i + 1]) for i in range(999)] + [(names[i], names[i + 1]) for i in range(1000, 1199)]
    spark.sparkContext.setJobGroup("path", "path")
    parts = dict(map(tuple, connected_parts(spark.createDataFrame(edges, "u long, v long")).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    spark.sparkContext.setJobGroup("rest", "rest")
    want = {n: min(group) for group in (names[:1000], names[1000:]) for n in group if n != min(group)}
    assert parts == want and jobs < 250


def test_no_candidates(spark):
    assert greedy_assignment(frame(spark, []).withColumn("x", F.lit(1))).count() == 0
