"""Exact similarity joins between two sets of names, without scoring every pair.

:func:`client_similarity` is the largest of an edit-distance ratio and two constants: 0.85 if the first two words agree, 0.75 if one name
contains the other.

* **ratio branch**, for ``1 - lev/maxlen >= t``. With k edits allowed, two names share at least ``maxlen + 1 - 2k`` of their padded bigrams
  (a multiset: gram and occurrence), so their *rarest* ``grams - shared + 1`` bigrams have one in common: join on those. In the join
  itself pairs are tested by length and by the bigrams and the characters that one has and the other lacks (multisets as bitmaps of 128 bits;
  ``2k`` and ``k`` at most). Only what passes all three is written, and gets the edit distance, cut off at k.
* **first-words branch** (score 0.85) - equi-join on the lower-cased first two words.
* **containment branch** (score 0.75, both 3+ chars) - if ``x`` is inside ``y`` then every trigram of ``x`` is a trigram of ``y``; join ``x``'s
  rarest trigram with all of ``y``'s trigrams, in both directions.

The bigram bound is sharp at high thresholds and empty at 0.5, so :func:`best_similar` goes down in stages: names for which a stage finds a
partner are done (all pairs at or above its threshold are known, the best among them), only the others go on to the next, lower one.

Every branch is a shuffle join on a token key; AQE splits skewed tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import CONTAINS_SCORE, FIRST_WORDS_SCORE, client_similarity, first_n_words
from ..session import cut_lineage, cut_lineages


#: thresholds of :func:`best_similar`, from the top
STAGES = (0.85, 0.75, 0.7, 0.6, 0.55, 0.5)
#: up to so many pairs of names one stage, at the floor, costs less than the jobs of all of them
ONE_STAGE_PAIRS = 250_000
#: cut-offs of the edit distance (the built-in takes literals only)
_CUTOFFS = (2, 4, 6, 9, 13, 20, 30)
_EPS = 1e-9


def _occurrences(parts: Column) -> Column:
    """Multiset as a set: each element with the number of its occurrence."""
    return F.transform(parts, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(parts, 1, i + 1), lambda x: x == c))))


def _bitmap(elements: str, half: int) -> Column:
    """Half of a set of 128 bits: one for each element, by its hash."""
    return F.expr(f"aggregate(filter({elements}, g -> pmod(shiftright(xxhash64(g), 32), 2L) = {half}), 0L, "
                  "(x, g) -> x | shiftleft(1L, cast(pmod(xxhash64(g), 64L) as int)))")


#: what a name shows of itself to every name it meets
_SHOWN = ("n", "m", "g0", "g1", "c0", "c1")


def _profiles(df: DataFrame) -> DataFrame:
    """id, s, low, n and m (lengths of s and low), grams (padded bigrams), g0, g1 (their bitmap), c0, c1 (that of the characters)."""
    p = df.select("id", "s", F.lower("s").alias("low")).withColumn("n", F.length("s")).withColumn("m", F.length("low"))
    padded = F.concat(F.lit("\u0002"), F.col("low"), F.lit("\u0003"))
    p = p.withColumn("pairs", F.transform(F.sequence(F.lit(1), F.col("m") + 1), lambda i: F.substring(padded, i, F.lit(2)))).withColumn("letters", F.split("low", ""))
    p = p.withColumn("grams", _occurrences(F.col("pairs"))).withColumn("chars", _occurrences(F.col("letters")))
    return p.select("id", "s", "low", "n", "m", "grams", *[_bitmap(x, h).alias(f"{x[0]}{h}") for x in ("grams", "chars") for h in (0, 1)])


def _prefix(m: Column, t: float) -> Column:
    """How many of a name's rarest bigrams are enough: a partner at or above t shares at least ``1 + (2t - 1) m`` of its m + 1."""
    return m + 1 - F.ceil(1 + (2 * t - 1) * m - _EPS) + 1


def _within(a: Column, b: Column, k: Column) -> Column:
    """Edit distance of a and b if it is at most k (or -1 from beyond a cut-off at or above k)."""
    out = F.levenshtein(a, b)
    for c in reversed(_CUTOFFS):
        out = F.when(k <= c, F.levenshtein(a, b, c)).otherwise(out)
    return out


def _rarest(tokens: DataFrame, key: str, keep: Column | None) -> DataFrame:
    """Rank each string's tokens by (global frequency, token); keep the rarest."""
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = tokens.join(freq, "token").withColumn(
        "rk", F.row_number().over(Window.partitionBy(key).orderBy("freq", "token")))
    return ranked.filter(keep if keep is not None else F.col("rk") == 1)


@dataclass
class RatioIndex:
    """Names of both sides and their bigrams, ranked from the rarest (written once, read by every stage)."""

    left: DataFrame   # id, s, low, n
    right: DataFrame
    tokens: DataFrame  # side, id, token, rk and what the name shows


def ratio_index(left: DataFrame, right: DataFrame) -> RatioIndex:
    lp, rp = cut_lineages(_profiles(left), _profiles(right))
    each = lambda p, side: p.select(F.lit(side).alias("side"), "id", *_SHOWN, F.explode("grams").alias("token"))
    t = each(lp, "l").unionByName(each(rp, "r"))
    t = t.withColumn("key", F.concat_ws("\u0001", "side", F.col("id").cast("string")))
    return RatioIndex(lp.drop("grams"), rp.drop("grams"), cut_lineage(_rarest(t, "key", F.lit(True)).select("side", "id", *_SHOWN, "token", "rk")))


def _may_reach(k: Column) -> Column:
    """Whether what two names show allows a distance of at most k: shared bigrams and shared characters."""
    l, r = ({c: F.col(f"{side}_{c}") for c in _SHOWN} for side in "lr")
    longest = F.greatest(l["m"], r["m"])
    tests = []
    for x, y in ((l, r), (r, l)):
        alone = lambda a, b: F.bit_count(x[a].bitwiseAND(F.bitwise_not(y[a]))) + F.bit_count(x[b].bitwiseAND(F.bitwise_not(y[b])))  # noqa: B023, E731
        tests.append(alone("g0", "g1") <= 2 * k - (longest - x["m"]))
        tests.append(alone("c0", "c1") <= k - (longest - x["m"]))
    return reduce(lambda x, y: x & y, tests)


def ratio_pairs(index: RatioIndex, threshold: float, only: DataFrame | None = None, told: dict | None = None) -> DataFrame:
    """Pairs (l, r) with ``1 - lev(lower)/maxlen >= threshold``, and their names l_s, r_s. ``only``: ids of the left side that are asked
    for. ``told`` gets the number of pairs that were scored."""
    pre = index.tokens.filter(F.col("rk") <= _prefix(F.col("m"), threshold))
    side = lambda name: pre.filter(F.col("side") == name).select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _SHOWN], "token")
    lt, rt = side("l"), side("r")
    if only is not None:
        lt = lt.join(only.select(F.col("id").alias("l")), "l", "left_semi")
    k = F.floor(F.greatest("l_n", "r_n") * (1 - threshold) + _EPS).cast("int")
    near = F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * threshold - _EPS
    # tested where the names meet: only pairs that pass are ever written or shuffled
    met = lt.join(rt, "token").filter(near & _may_reach(k)).select("l", "r").distinct()
    names = lambda p, x: p.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("s", "low", "n")])
    pairs = met.join(names(index.left, "l"), "l").join(names(index.right, "r"), "r")
    if told is not None:
        pairs = cut_lineage(pairs)
        told["scored"] = pairs.count()
    d = _within(F.col("l_low"), F.col("r_low"), k)
    return pairs.withColumn("d", d).filter((F.col("d") >= 0) & (F.col("d") <= k)).select("l", "r", "l_s", "r_s")


def first_words_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    lf = left.select(F.col("id").alias("l"), F.lower(first_n_words(F.col("s"))).alias("fw")).filter("fw <> ''")
    rf = right.select(F.col("id").alias("r"), F.lower(first_n_words(F.col("s"))).alias("fw")).filter("fw <> ''")
    return lf.join(rf, "fw").select("l", "r")


def _qgrams(s: Column, q) -> Column:
    """Distinct q-grams of ``lower(s)`` tagged with q (``q`` int or Column)."""
    low = F.lower(s)
    q = F.lit(q) if isinstance(q, int) else q
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - q + 1, F.lit(1))),
                                        lambda i: F.concat(q.cast("string"), F.lit(":"), F.substring(low, i, q))))


def contains_candidates(left: DataFrame, right: DataFrame, min_len: int = 3) -> DataFrame:
    """Pairs where one string may contain the other, case-insensitively.

    The contained string ``x`` (``min_len``+ chars) is probed with its single
    q-gram (q = min(3, len x)) that is rarest among the containing side's
    q-grams; every q-gram of ``x`` occurs in any ``y`` containing it, so the
    join on that one token is lossless and has the smallest fan-out."""
    qs = [3] if min_len >= 3 else [q for q in (1, 2, 3) if q >= min_len]

    def build(df: DataFrame) -> DataFrame:
        grams = F.array_distinct(F.flatten(F.array(*[_qgrams(F.col("s"), q) for q in qs])))
        return df.select("id", F.explode(grams).alias("token"))

    def probe(df: DataFrame, built: DataFrame) -> DataFrame:
        q = F.least(F.length("s"), F.lit(3))
        toks = df.filter(F.length("s") >= min_len).select("id", F.explode(_qgrams(F.col("s"), q)).alias("token"))
        freq = built.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
        ranked = toks.join(freq, "token").withColumn(
            "rk", F.row_number().over(Window.partitionBy("id").orderBy("freq", "token")))
        return ranked.filter("rk = 1").select("id", "token")

    bl, br = build(left), build(right)
    l_in_r = probe(left, br).join(br.withColumnRenamed("id", "r"), "token").select(F.col("id").alias("l"), "r")
    r_in_l = probe(right, bl).join(bl.withColumnRenamed("id", "l"), "token").select("l", F.col("id").alias("r"))
    return l_in_r.unionByName(r_in_l)


def client_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs that can reach ``client_similarity >= threshold`` (distinct ``l``, ``r``)."""
    left = left.filter(F.col("s") != "")
    right = right.filter(F.col("s") != "")
    out = ratio_pairs(ratio_index(left, right), threshold).select("l", "r")
    if FIRST_WORDS_SCORE >= threshold:
        out = out.unionByName(first_words_candidates(left, right))
    if CONTAINS_SCORE >= threshold:
        out = out.unionByName(contains_candidates(left, right))
    return out.distinct()


def best_similar(left: DataFrame, right: DataFrame, floor: float, report: list[dict] | None = None,
                 one_stage_pairs: int = ONE_STAGE_PAIRS) -> DataFrame:
    """(l, r, score) with, for every left name that reaches ``floor`` with any right name, all its best pairs (and perhaps lesser ones).

    Goes down the stages; what a name has found at one of them holds its best score, so it takes no part in the next. ``report`` gets
    a row for each stage: threshold, left names asked, pairs scored and pairs found. Up to ``one_stage_pairs`` pairs of names there is one stage, the floor."""
    left = left.filter(F.col("s") != "").select("id", "s")
    right = right.filter(F.col("s") != "").select("id", "s")
    index = ratio_index(left, right)
    todo, out, above = index.left.select("id", "s"), None, 1.0 + _EPS
    few = index.left.count() * index.right.count() <= one_stage_pairs
    for t in [x for x in STAGES if x > floor and not few] + [floor]:
        told = None if report is None else {"threshold": t, "asked": todo.count()}
        pairs = ratio_pairs(index, t, todo, told)
        # the constant scores count at the first stage that reaches them: whoever has them goes no further
        others = [join(todo, right) for score, join in ((FIRST_WORDS_SCORE, first_words_candidates), (CONTAINS_SCORE, contains_candidates)) if t <= score < above]
        above = t
        if others:
            texts = lambda p, x: p.select(F.col("id").alias(x), F.col("s").alias(f"{x}_s"))
            more = reduce(DataFrame.unionByName, others).distinct().join(texts(todo, "l"), "l").join(texts(right, "r"), "r")
            pairs = pairs.unionByName(more).distinct()
        scored = pairs.select("l", "r", client_similarity(F.col("l_s"), F.col("r_s")).alias("score")).filter(F.col("score") >= t)
        found = cut_lineage(scored)
        if report is not None:
            report.append({**told, "found": found.count()})
        out = found if out is None else out.unionByName(found)
        todo = index.left.select("id", "s").join(out.select(F.col("l").alias("id")), "id", "left_anti")
        if t != floor and todo.isEmpty():
            break
    return out
