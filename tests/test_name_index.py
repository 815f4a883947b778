"""Candidate pairs of employee names hold every pair that can reach the threshold; D7 and D8 over them equal all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tieout.functions.similarity import first_two_words_similar, name_similarity, normalize_employee
from tieout.operators.employees import best_by_name, extract_best_by_name
from tieout.operators.name_index import best_employee, extract_best_employee, name_candidates

FIRST = ["Marta", "Alonso", "Hector", "Juana", "Jo", "Al", "Ricardo", "Ricarda", "Ana Maria", "X"]
LAST = ["Mendoza", "Vizcarra", "Mendosa", "Okafor", "Diaz", "Di", "Mendoza-Diaz", "O'Neil", "Li"]


def some_names(rng, n):
    out = set()
    while len(out) < n:
        kind = rng.randrange(6)
        name = f"{rng.choice(FIRST)} {rng.choice(LAST)}"
        if kind == 1:
            name = " ".join(reversed(name.split(" ")))
        if kind == 2:
            name = f"{name} {rng.choice(LAST)}"
        if kind == 3:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice("aeiou xz") + name[i + 1:]
        if kind == 4:
            name = rng.choice([name.split()[0], name.upper(), f"{name} {name}", "".join(rng.choices("abc ", k=rng.randint(1, 7)))])
        if name.strip():
            out.add(name)
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [(g, x) for g in ("one", "two", "three") for x in some_names(rng, 45)] + [("one", "--"), ("two", " ")]
    right = [(g, x) for g in ("one", "two", "four") for x in some_names(rng, 55)] + [("one", "..")]
    frame = lambda rows: spark.createDataFrame(rows, "unified_name string, name string")
    return frame(left), frame(right)


def normed(df):
    return df.select(F.col("unified_name").alias("g"), F.col("name").alias("id"), normalize_employee("name").alias("norm"))


@pytest.mark.parametrize("t", [0.6, 0.8, 0.7])
def test_candidates_lose_no_pair(sides, t):
    left, right = map(normed, sides)
    pairs = left.alias("x").join(right.alias("y"), F.col("x.g") == F.col("y.g"))
    hit = (name_similarity(F.col("x.norm"), F.col("y.norm")) >= t) | first_two_words_similar(F.col("x.norm"), F.col("y.norm"))
    want = {tuple(r) for r in pairs.filter(hit).select("x.g", "x.id", "y.id").collect()}
    got = {tuple(r) for r in name_candidates(left, right, t).collect()}
    assert want <= got and len(got) < pairs.count()


def all_pairs(sides):
    left, right = sides
    return left.join(right.withColumnRenamed("name", "choice"), "unified_name").select(
        "unified_name", F.col("name").alias("target"), "choice", F.col("choice").alias("choice_ord"))


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_best_employee_equals_all_pairs(sides):
    want = best_by_name(all_pairs(sides), group="unified_name")
    assert rounded(best_employee(*sides)) == rounded(want)
    assert want.select("tier").distinct().count() >= 4


def test_extract_best_employee_equals_all_pairs(sides):
    every = sides[0].select("unified_name", F.col("name").alias("target"))
    for t in (0.8, 0.6):
        assert rounded(extract_best_employee(*sides, t)) == rounded(extract_best_by_name(all_pairs(sides), t, group="unified_name", targets=every))


def test_nothing_to_match(sides):
    assert best_employee(sides[0].limit(0), sides[1]).count() == 0 and best_employee(sides[0], sides[1].limit(0)).count() == 0
