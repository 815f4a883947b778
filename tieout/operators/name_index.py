"""Candidate pairs of employee names inside each client, and the name-only matches made from them.

``name_candidates`` finds every pair of one client whose :func:`name_similarity` may reach a threshold t, without meeting all pairs. A name's
entries are the whole name, the name without repeated words (if it has any), its first and its last word; an entry's tokens are the bigrams of its
words, each word with a mark before and after it, so the order of the words does not matter.

* Ratio, word-sorted ratio, word-set ratio and the windowed ratio at t leave at most ``k = (1 - t) * length`` of the shorter entry's characters, and ``2k + 2`` of
  its bigrams, without a partner in the longer one. So one of the shorter entry's ``2k + 3`` rarest bigrams is in the longer one: these are
  joined with all bigrams of longer entries. Entries too short for that are joined on their ``k + 1`` rarest characters.
* The component score is 0.95 for a name that goes on with further words (a windowed ratio of 1), 0.85 for two equal first words (an equi-join),
  else the mean of the first and the last words' ratios: one of them reaches t, and the first and last words are entries.

Rarity is counted inside the client, so a client with a third of all employees has its own rare tokens. Pairs are tested inside the join by
bitmaps of what an entry has; only those that pass are written and scored, each distinct pair of names once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import first_n_words, normalize_employee, words
from ..functions.text import is_blank
from ..session import cut_lineage
from .blocking import _EPS, _bitmap, _occurrences
from .employees import (EXTRACT_THRESHOLD, NAME_ONLY_HIGH, NAME_ONLY_LOW, best_by_name, extract_best_by_name,
                        name_only_matches)

_SHOWN = ("m", "g0", "g1", "c0", "c1")


def _entries(names: DataFrame) -> DataFrame:
    """names: g, id, norm. g, id, role (n: name, f, l: first and last word), text."""
    w = words(F.lower("norm"))
    p = names.filter("norm <> ''").select("g", "id", w.alias("w")).withColumn("d", F.array_distinct("w"))
    join = lambda c: F.array_join(c, " ")
    several = F.size("w") > 1
    rows = F.array(F.struct(F.lit("n").alias("role"), join("w").alias("text")),
                   F.when(F.size("d") < F.size("w"), F.struct(F.lit("n").alias("role"), join("d").alias("text"))),
                   F.when(several, F.struct(F.lit("f").alias("role"), F.element_at("w", 1).alias("text"))),
                   F.when(several, F.struct(F.lit("l").alias("role"), F.element_at("w", -1).alias("text"))))
    return p.select("g", "id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("g", "id", "e.role", "e.text")


def _tokens(entries: DataFrame) -> DataFrame:
    """g, id, role, kind (g: bigram, c: character), token and what the entry shows of itself."""
    marked = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("\u0002"), w, F.lit("\u0003")))
    grams = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    p = entries.withColumn("m", F.length("text")).withColumn("pairs", grams).withColumn("letters", F.split("text", ""))
    p = p.withColumn("grams", _occurrences(F.col("pairs"))).withColumn("chars", _occurrences(F.col("letters")))
    p = p.select("g", "id", "role", "text", "m", "grams", "chars", *[_bitmap(x, h).alias(f"{x[0]}{h}") for x in ("grams", "chars") for h in (0, 1)])
    tagged = lambda c, kind: F.transform(c, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    p = p.select("g", "id", "role", "text", *_SHOWN, F.explode(F.concat(tagged("grams", "g"), tagged("chars", "c"))).alias("t"))
    return p.select("g", "id", "role", "text", *_SHOWN, "t.kind", "t.token")


def token_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tokens of both sides, ranked from the rarest of the client (written once). left, right: g, id, norm."""
    each = lambda df, side: _tokens(_entries(df)).withColumn("side", F.lit(side))
    t = each(left, "l").unionByName(each(right, "r"))
    freq = t.groupBy("g", "role", "kind", "token").agg(F.count(F.lit(1)).alias("freq"))
    rarest = Window.partitionBy("side", "g", "id", "role", "text", "kind").orderBy("freq", "token")  # one entry's tokens
    ranked = t.join(freq, ["g", "role", "kind", "token"]).withColumn("rk", F.row_number().over(rarest))
    return cut_lineage(ranked.drop("freq", "text"))


def _alone(x: str, y: str, c: str) -> Column:
    return sum(F.bit_count(F.col(f"{x}_{c}{h}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{c}{h}")))) for h in (0, 1))


def _probe(index: DataFrame, short: str, long: str, t: float, only: DataFrame | None) -> DataFrame:
    k = F.floor(F.col("m") * (1 - t) + _EPS).cast("int")
    by_gram = F.col("m") - 1 - 2 * k >= 1
    first = F.when(by_gram, (F.col("kind") == "g") & (F.col("rk") <= 2 * k + 3)).otherwise((F.col("kind") == "c") & (F.col("rk") <= k + 1))
    key = ["g", "role", "kind", "token"]
    side = lambda df, x: df.select(*key, F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _SHOWN])
    rows = {x: index.filter(F.col("side") == x) for x in "lr"}
    if only is not None:
        rows["l"] = rows["l"].join(only.select("g", "id"), ["g", "id"], "left_semi")
    met = side(rows[short].filter(first), short).join(side(rows[long], long), key)
    shorter = F.col(f"{short}_m")
    most = F.floor(shorter * (1 - t) + _EPS).cast("int")
    order = shorter <= F.col(f"{long}_m") if short == "l" else shorter < F.col(f"{long}_m")
    return met.filter(order & (_alone(short, long, "c") <= most) & (_alone(short, long, "g") <= 2 * most + 2)).select("g", "l", "r")


def name_candidates(left: DataFrame, right: DataFrame, t: float, index: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(g, l, r): every pair of one client that may reach ``name_similarity >= t``, or whose first two words agree. left, right: g, id,
    norm (normalised name). ``only`` (g, id): the left names asked for; ``index``: :func:`token_index` of both sides."""
    index = token_index(left, right) if index is None else index
    out = _probe(index, "l", "r", t, only).unionByName(_probe(index, "r", "l", t, only))
    asked = left if only is None else left.join(only.select("g", "id"), ["g", "id"], "left_semi")
    two = lambda df, x: df.filter(F.size(words(F.col("norm"))) >= 2).select("g", F.col("id").alias(x), F.lower(first_n_words("norm")).alias("two"))
    return out.unionByName(two(asked, "l").join(two(right, "r"), ["g", "two"]).select("g", "l", "r")).distinct()


# --- D7 / D8 / D10 over whole clients --------------------------------------------------------------------

def _sides(targets: DataFrame, choices: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    side = lambda df: df.filter(~is_blank(F.col("name"))).select(F.col(group).alias("g"), F.col("name").alias("id"), normalize_employee("name").alias("norm")).distinct()
    return cut_lineage(side(targets)), cut_lineage(side(choices))


def _named(pairs: DataFrame, group: str) -> DataFrame:
    return pairs.select(F.col("g").alias(group), F.col("l").alias("target"), F.col("r").alias("choice"), F.col("r").alias("choice_ord"))


def best_employee(targets: DataFrame, choices: DataFrame, group: str = "unified_name") -> DataFrame:
    """D7 for every target (``group``, name) among its group's choices (``group``, name; ties go to the first name in binary order): (group, target,
    best_match, tier, ns). Goes down in three steps, each for the names still without a match: equal normalised names (tiers 1, 2), pairs that
    may reach 0.8 (components, first two words, similarity: tiers 3 to 5), pairs that may reach 0.6 (tier 6)."""
    left, right = _sides(targets, choices, group)
    low = lambda df, x: df.select("g", F.col("id").alias(x), F.lower("norm").alias("k"))
    out = cut_lineage(best_by_name(_named(low(left, "l").join(low(right, "r"), ["g", "k"]), group), group=group))
    index = token_index(left, right)
    for t, last_tier in ((NAME_ONLY_HIGH, 5), (NAME_ONLY_LOW, 6)):
        found = out.select(F.col(group).alias("g"), F.col("target").alias("id"))
        todo = left.join(found, ["g", "id"], "left_anti").select("g", "id")
        pairs = name_candidates(left, right, t, index, todo)
        out = out.unionByName(cut_lineage(best_by_name(_named(pairs, group), group=group).filter(F.col("tier") <= last_tier)))
    return out


def extract_best_employee(targets: DataFrame, choices: DataFrame, threshold: float = EXTRACT_THRESHOLD, group: str = "unified_name") -> DataFrame:
    """D8 for every target among its group's choices: (group, target, best_match, score, reason)."""
    left, right = _sides(targets, choices, group)
    pairs = _named(name_candidates(left, right, threshold), group)
    every = targets.select(group, F.col("name").alias("target")).distinct()
    return extract_best_by_name(pairs, threshold, group=group, targets=every)


def employee_match_table(ledger_emps: DataFrame, payroll_emps: DataFrame, group: str = "unified_name") -> DataFrame:
    """D10 over whole clients. ledger_emps: (group, name, amount, ord); payroll_emps: (group, name, amount)."""
    best = best_employee(ledger_emps, payroll_emps, group)
    return name_only_matches(None, ledger_emps, payroll_emps, group, best=best)
