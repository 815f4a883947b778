"""Candidate pairs of the amount-aware employee match (D9), bounded before a name is scored.

A composite of at least ``t`` asks for a name similarity of at least ``t / (0.3 + 0.7 * smaller / larger)``, or of ``t - 0.3`` where the amounts are
equal: the further apart two amounts are, the closer the names must be. So both sides meet on (client, sign, logarithm of the amount), and a
pair is tested where it meets, by

* the amounts: smaller / larger of at least 3/7,
* the words: the best that first and last words can give (two short edit distances),
* the letters: the best that the edit-distance measures can give. Whole names, sorted words, distinct words and windows are all made of a
  name's own characters and bigrams (each word once, with a space on either side), so with ``c`` characters and ``g`` bigrams in common and
  the compared strings at least ``L`` long, none of these measures exceeds ``c / L`` nor ``((g + 1) / L + 1) / 2`` (an edit spoils two bigrams).
  The common parts are counted from above by bitmaps of 128 bits.
* the edits, where the letters allow it: two distances of whole names, which also bound the windows.

Only pairs whose bound reaches what their amounts ask for are written. Their names are scored once for each distinct pair, and the windowed
measure (C15, one edit distance for each window) only where its bound can still change the result.

A group of one client, sign and amount band with very many pairs is dealt out over a grid: rows of one side by rows of the other, each
cell of at most ``PAIRS_PER_CELL`` pairs on average. No pair is lost, and each meets in one cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import (EXACT_AMOUNT_BOOST, FIRST_TWO_COMPONENT_SCORE, PREFIX_COMPONENT_SCORE, component_similarity,
                                    ratio, string_similarity, token_set_ratio, token_sort_ratio, words)
from ..session import cut_lineage
from .blocking import _bitmap, _occurrences

#: pairs that one cell of a hot group, and one task, holds on average
PAIRS_PER_CELL = 2_000_000
#: rows of a task that meets few pairs
ROWS_PER_PARTITION = 500_000
MAX_PARTITIONS = 100_000
_BAND = math.log(7.0 / 3.0)
_EPS = 1e-9
_KEYS = ("unified_name", "sg", "bk")
#: what a name shows of itself: lower-cased, with sorted words, its distinct words; lengths, bitmaps of bigrams and characters,
#: number of words, first and last word
_SHOWN = ("low", "sorted", "words", "n", "d", "g0", "g1", "c0", "c1", "nw", "first", "last", "size")


def _bucket(x: Column) -> Column:
    # a hair wider than the band, so rounding in the logarithm cannot put a pair two buckets apart
    return F.floor(F.log(F.abs(x).cast("double")) / F.lit(_BAND * 1.001)).cast("long")


def profile(df: DataFrame, name: str, amount: str, side: str) -> DataFrame:
    """``df`` (normalised, single-spaced ``name``) with what the name and the amount show, as ``<side>_<column>``, and sg, bk."""
    low, w = F.col("low"), words(F.col(name))
    out = df.withColumn("low", F.lower(F.col(name))).withColumn("n", F.length("low"))
    out = out.withColumn("sorted", F.array_join(F.array_sort(words(low)), " ")).withColumn("words", F.array_distinct(words(low)))
    out = out.withColumn("d", F.length(F.array_join("words", " ")))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    out = out.withColumn("pairs", F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.substring(padded, i, F.lit(2))))
    out = out.withColumn("letters", F.split(low, ""))  # columns of their own: an expression would be evaluated again for each element
    out = out.withColumn("grams", _occurrences(F.col("pairs"))).withColumn("chars", _occurrences(F.col("letters")))
    for c in ("grams", "chars"):
        for half in (0, 1):
            out = out.withColumn(f"{c[0]}{half}", _bitmap(c, half))
    out = (out.withColumn("nw", F.size(w)).withColumn("first", F.when(F.size(w) > 0, F.element_at(w, 1)).otherwise(""))
           .withColumn("last", F.when(F.size(w) > 1, F.element_at(w, -1)).otherwise(""))
           .withColumn("size", F.col(amount).cast("double")).withColumn("sg", F.signum("size").cast("int"))
           .withColumn("bk", F.when(F.col("size") == 0, F.lit(0)).otherwise(_bucket(F.col(amount)))))
    return out.drop("pairs", "letters", "grams", "chars").withColumnsRenamed({c: f"{side}_{c}" for c in _SHOWN})


def meet(lp: DataFrame, pp: DataFrame, pairs_per_cell: int = PAIRS_PER_CELL) -> DataFrame:
    """All pairs of profiled ledger and payroll rows in the same client, sign and neighbouring amount bands (untested)."""
    near = F.when(F.col("sg") == 0, F.array("bk")).otherwise(F.sequence(F.col("bk") - 1, F.col("bk") + 1))
    lp = lp.withColumn("bk", F.explode(near))
    count = lambda df, c: df.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias(c))
    cells = F.ceil(F.sqrt(F.col("nl").cast("double") * F.col("np") / pairs_per_cell)).cast("int")
    groups = cut_lineage(count(lp, "nl").join(count(pp, "np"), list(_KEYS)).withColumn("cells", cells))
    rows, pairs, most = groups.agg(F.sum((F.col("nl") + F.col("np")) * F.col("cells")), F.sum(F.col("nl").cast("double") * F.col("np")), F.max("cells")).first()
    # work goes with the pairs, not with the bytes by which partitions would be merged: so their number is set
    parts = min(MAX_PARTITIONS, 1 + int((pairs or 0) // pairs_per_cell) + (rows or 0) // ROWS_PER_PARTITION)
    hot = groups.filter("cells > 1").select(*_KEYS, "cells")

    def deal(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        n = F.coalesce("cells", F.lit(1))
        df = df.join(hot, list(_KEYS), "left") if (most or 0) > 1 else df.withColumn("cells", F.lit(1))
        df = df.withColumn(own, F.pmod(F.xxhash64(name), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), n - 1))).drop("cells")
        return df.repartition(parts, *_KEYS, "row", "column")

    return deal(lp, "l_item", "row", "column").join(deal(pp, "p_name", "column", "row"), [*_KEYS, "row", "column"])


def amounts_near() -> Column:
    """Whether two amounts of the same sign are within the factor that a composite of 0.6 allows."""
    a, b = F.abs("l_size"), F.abs("p_size")
    return F.least(a, b) >= 0.42 * F.greatest(a, b)


def name_asked(threshold: float) -> Column:
    """The name similarity that two amounts of the same sign ask for."""
    a, b = F.abs("l_size"), F.abs("p_size")
    return (F.when(F.abs(F.col("l_size") - F.col("p_size")) < 0.010001, F.lit(threshold - EXACT_AMOUNT_BOOST))
            .otherwise(F.lit(threshold) / (0.3 + 0.7 * F.least(a, b) / F.greatest(a, b))))


def letters_bound() -> Column:
    """No measure on letters (C14-C17) exceeds this."""
    def shared(kind: str, more: int) -> Column:
        def of(x: str, y: str) -> Column:
            alone = [F.bit_count(F.col(f"{x}_{kind}{h}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{kind}{h}")))) for h in (0, 1)]
            return F.col(f"{x}_n") + more - alone[0] - alone[1]
        return F.least(of("l", "p"), of("p", "l"))

    longest = F.least(F.col("l_n"), F.col("p_n"), F.greatest("l_d", "p_d"))
    return F.least(F.lit(1.0), shared("c", 0) / longest, ((shared("g", 1) + 1) / longest + 1) / 2)


def windows_bound() -> Column:
    """The windowed measure (C15) does not exceed this. The longer name is a window and ``longer - shorter`` further characters, so
    the distance of the whole names is at most the window's and that difference."""
    longest, shortest = F.greatest("l_n", "p_n"), F.least("l_n", "p_n")
    return F.least(letters_bound(), (longest - F.levenshtein("l_low", "p_low")) / shortest)


def edits_bound() -> Column:
    """Together with :func:`letters_bound` no measure on letters exceeds this: windows (and with them whole names) by the distance of the
    whole names, sorted words by theirs; distinct words (C17) equal the sorted ones unless a word is shared or repeated."""
    longest = F.greatest("l_n", "p_n")
    mixed = F.arrays_overlap("l_words", "p_words") | (F.col("l_d") != F.col("l_n")) | (F.col("p_d") != F.col("p_n"))
    return (F.when(mixed, F.lit(1.0))
            .otherwise(F.greatest((longest - F.levenshtein("l_low", "p_low")) / F.least("l_n", "p_n"), 1 - F.levenshtein("l_sorted", "p_sorted") / longest)))


def words_bound() -> Column:
    """The component measure (C18) does not exceed this."""
    mean = (string_similarity(F.col("l_first"), F.col("p_first")) + string_similarity(F.col("l_last"), F.col("p_last"))) / 2.0
    agree = (F.col("l_nw") != F.col("p_nw")) & (F.lower("l_first") == F.lower("p_first"))
    return F.greatest(F.when(agree, F.lit(max(PREFIX_COMPONENT_SCORE, FIRST_TWO_COMPONENT_SCORE))).otherwise(F.lit(0.0)), mean)


def that_may_reach(met: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose bounds allow a composite of ``threshold``; an empty name never does. Each bound is a step of its own (a one-element
    explode, which filters are not pushed through): as one join condition they compile into a method too large for the JVM to optimise."""
    step = lambda df, name, c: df.withColumn(name, F.explode(F.array(c)))
    out = met.filter((F.col("l_n") > 0) & (F.col("p_n") > 0) & amounts_near_or_zero())
    out = step(out, "wanted", name_asked(threshold) - _EPS)
    out = step(out, "by_letters", letters_bound())
    out = step(out, "by_edits", F.when(F.col("by_letters") >= F.col("wanted"), edits_bound()).otherwise(F.lit(0.0)))
    return out.filter((F.col("by_edits") >= F.col("wanted")) | (words_bound() >= F.col("wanted"))).drop("wanted", "by_letters", "by_edits")


def amounts_near_or_zero() -> Column:
    return (F.col("l_size") == 0) | amounts_near()


def windows_matter() -> Column:
    """Whether the windowed measure can still raise ``cheap``, or reach what the pair asks for (columns bound, asked, cheap, tn, cn)."""
    return ((F.col("bound") > F.col("cheap") - _EPS) & (F.col("bound") >= F.col("asked") - _EPS)
            & (F.length(F.lower("tn")) != F.length(F.lower("cn"))))


def distinct_names(pairs: DataFrame, threshold: float) -> DataFrame:
    """Each distinct (tn, cn) of the pairs that met with its bound, the least that any pair asks of it, and ``cheap``: the best of all but the windows."""
    names = (pairs.withColumn("asked", name_asked(threshold)).withColumn("bound", windows_bound())
             .groupBy(F.col("l_norm").alias("tn"), F.col("p_norm").alias("cn"))
             .agg(F.min("asked").alias("asked"), F.min("bound").alias("bound")))
    a, b = F.col("tn"), F.col("cn")
    exact = F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(F.lit(0.0))
    return names.withColumn("cheap", F.greatest(exact, ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b), component_similarity(a, b)))


def with_bounded_scores(pairs: DataFrame, threshold: float) -> DataFrame:
    """Adds name_sim (C19) to pairs that met. Where it stays below what every pair of these names asks for, it may lack the windowed measure."""
    names = distinct_names(pairs, threshold)
    # the shorter and the longer name as columns of their own: the lambda then holds one edit distance and nothing else
    a, b = F.lower("tn"), F.lower("cn")
    swap = F.length(a) > F.length(b)
    names = names.withColumn("both", F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("t")))
    names = names.withColumn("s", F.col("both.s")).withColumn("t", F.col("both.t")).withColumn("ls", F.length("s"))
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("ls") + 1), lambda i: F.levenshtein(F.col("s"), F.substring(F.col("t"), i, F.col("ls")))))
    sim = F.when(windows_matter(), F.greatest("cheap", F.lit(1.0) - least / F.col("ls"))).otherwise(F.col("cheap"))
    names = names.select(F.col("tn").alias("l_norm"), F.col("cn").alias("p_norm"), sim.alias("name_sim"))
    return pairs.join(names, ["l_norm", "p_norm"])
