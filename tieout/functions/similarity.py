"""Name normalisation and similarity scores (C1-C23) as Column expressions.

Every function maps Columns to a Column built from Spark built-ins
(``levenshtein``, ``regexp_replace``, array higher-order functions), so the
scores are computed JVM-side next to the join that produced the pair.
Case-insensitive equality is ``lower(a) = lower(b)``; edit distance counts
code points. Scores are doubles compared unrounded against thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, is_blank, trim_ws

# Fixed values (must equal the reference for identical results) -----------------
# Company suffixes removed, as whole words, anywhere in a client name.
CLIENT_SUFFIX_PATTERN = r"(?iU)\b(LLC|Inc\.?|Corp\.?|Corporation|Company|Co\.?|Ltd\.?|Limited)\b"
FIRST_WORDS_SCORE = 0.85
CONTAINS_SCORE = 0.75
PREFIX_COMPONENT_SCORE = 0.95
FIRST_TWO_COMPONENT_SCORE = 0.85
EXACT_AMOUNT_BOOST = 0.3
# ------------------------------------------------------------------------------

_NON_WORD = r"(?U)[^\w\s]"
_SPACES = r"(?U)\s+"


def _ci_eq(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def words(c) -> Column:
    """``Split(' ', RemoveEmptyEntries)``."""
    return F.filter(F.split(col_(c), " "), lambda w: w != "")


# --- C1 / C9 normalisation -----------------------------------------------------

def normalize_client(c) -> Column:
    """Trim; drop company suffixes (any position); non-word -> space; collapse."""
    c = col_(c)
    s = F.regexp_replace(trim_ws(c), CLIENT_SUFFIX_PATTERN, "")
    s = F.regexp_replace(s, _NON_WORD, " ")
    s = trim_ws(F.regexp_replace(s, _SPACES, " "))
    return F.when(is_blank(c), F.lit("")).otherwise(s)


def normalize_employee(c) -> Column:
    """Trim; ``[-_.]+`` -> space; non-word -> space; collapse."""
    c = col_(c)
    s = F.regexp_replace(trim_ws(c), r"[-_.]+", " ")
    s = F.regexp_replace(s, _NON_WORD, " ")
    s = trim_ws(F.regexp_replace(s, _SPACES, " "))
    return F.when(is_blank(c), F.lit("")).otherwise(s)


def first_n_words(c, n: int = 2) -> Column:
    """The first ``n`` space-separated words, single-space joined."""
    c = col_(c)
    return F.when(is_blank(c), F.lit("")).otherwise(F.array_join(F.slice(words(c), 1, n), " "))


# --- client scores (C3-C8) -------------------------------------------------------

def lev_ratio(a, b) -> Column:
    """C4: ``1 - lev(lower)/maxlen``; two empty strings score 1."""
    a, b = col_(a), col_(b)
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(F.lower(a), F.lower(b)) / m)


def first_words_score(a, b) -> Column:
    """0.85 when the first two words are equal ignoring case."""
    fa, fb = first_n_words(a), first_n_words(b)
    return F.when((fa != "") & (fb != "") & _ci_eq(fa, fb), F.lit(FIRST_WORDS_SCORE)).otherwise(F.lit(0.0))


def contains_score(a, b) -> Column:
    """0.75 when both have 3+ characters and one contains the other."""
    a, b = col_(a), col_(b)
    la, lb = F.lower(a), F.lower(b)
    hit = (F.length(a) >= 3) & (F.length(b) >= 3) & ((F.instr(la, lb) > 0) | (F.instr(lb, la) > 0))
    return F.when(hit, F.lit(CONTAINS_SCORE)).otherwise(F.lit(0.0))


def client_similarity(a, b) -> Column:
    """max(exact, ratio, first words, contains); an empty side scores 0."""
    a, b = col_(a), col_(b)
    exact = F.when(_ci_eq(a, b), F.lit(1.0)).otherwise(F.lit(0.0))
    best = F.greatest(exact, lev_ratio(a, b), first_words_score(a, b), contains_score(a, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(best)


def percent0(c) -> Column:
    """``P0`` text: a whole percentage with a '%' sign."""
    return F.concat(F.round(col_(c) * 100, 0).cast("long").cast("string"), F.lit("%"))


def client_match_reason(a, b) -> Column:
    """Priority (not max) of exact, first words, contains, similarity."""
    a, b = col_(a), col_(b)
    r, fw, ct = lev_ratio(a, b), first_words_score(a, b), contains_score(a, b)
    return (F.when(_ci_eq(a, b), F.lit("Exact match"))
            .when(fw > 0, F.concat(F.lit("First words match ("), percent0(fw), F.lit(")")))
            .when(ct > 0, F.concat(F.lit("Contains match ("), percent0(ct), F.lit(")")))
            .when(r > 0, F.concat(F.lit("Similarity match ("), percent0(r), F.lit(")")))
            .otherwise(F.lit("No significant match")))


# --- employee scores (C10-C20) ---------------------------------------------------

def string_similarity(a, b) -> Column:
    """``1 - lev(lower)/maxlen``; either side empty -> 0."""
    a, b = col_(a), col_(b)
    m = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(F.lower(a), F.lower(b)) / m)


def name_components(c) -> Column:
    """struct(first, middle, last, full, n_words, valid)."""
    c = col_(c)
    w = words(c)
    n = F.size(w)
    blank = is_blank(c)
    first = F.when(blank | (n == 0), F.lit("")).otherwise(F.element_at(w, 1))
    middle = F.when(blank | (n <= 2), F.lit("")).otherwise(F.element_at(w, 2))
    last = F.when(blank | (n <= 1), F.lit("")).otherwise(F.element_at(w, -1))
    return F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"),
                    F.when(blank, F.lit("")).otherwise(c).alias("full"),
                    ((first != "") & (last != "")).alias("valid"))


def _prefix_words_equal(wa: Column, wb: Column) -> Column:
    """All words of the shorter list equal (ignoring case) the longer's first words."""
    la, lb = F.transform(wa, lambda x: F.lower(x)), F.transform(wb, lambda x: F.lower(x))
    na, nb = F.size(la), F.size(lb)
    return F.when(na < nb, F.slice(lb, 1, na) == la).otherwise(F.slice(la, 1, nb) == lb)


def _first_two_equal(wa: Column, wb: Column) -> Column:
    return ((F.size(wa) >= 2) & (F.size(wb) >= 2)
            & _ci_eq(F.element_at(wa, 1), F.element_at(wb, 1))
            & _ci_eq(F.element_at(wa, 2), F.element_at(wb, 2)))


def components_similar(a, b) -> Column:
    """C11: same person by first/last name (inputs normalised, both valid)."""
    a, b = col_(a), col_(b)
    ca, cb = name_components(a), name_components(b)
    wa, wb = words(ca["full"]), words(cb["full"])
    first_ok = _ci_eq(ca["first"], cb["first"]) | (string_similarity(ca["first"], cb["first"]) >= 0.8)
    last_ok = _ci_eq(ca["last"], cb["last"]) | (string_similarity(ca["last"], cb["last"]) >= 0.8)
    return (F.when((ca["first"] == "") | (cb["first"] == ""), F.lit(False))
            .when(~first_ok, F.lit(False))
            .when(F.size(wa) != F.size(wb), _prefix_words_equal(wa, wb))
            .when((ca["last"] != "") & (cb["last"] != ""), last_ok)
            .otherwise(string_similarity(ca["full"], cb["full"]) >= 0.8))


def first_two_words_similar(a, b) -> Column:
    """Both have 2+ words and the first two are equal ignoring case."""
    a, b = col_(a), col_(b)
    return F.when(is_blank(a) | is_blank(b), F.lit(False)).otherwise(_first_two_equal(words(a), words(b)))


def ratio(a, b) -> Column:
    """C14."""
    return string_similarity(F.lower(col_(a)), F.lower(col_(b)))


def partial_ratio(a, b) -> Column:
    """Best C13 of the shorter against each same-length window of the longer."""
    a, b = F.lower(col_(a)), F.lower(col_(b))
    a_short = F.length(a) <= F.length(b)
    s = F.when(a_short, a).otherwise(b)
    t = F.when(a_short, b).otherwise(a)
    ls, lt = F.length(s), F.length(t)
    windows = F.transform(F.sequence(F.lit(1), lt - ls + 1),
                          lambda i: string_similarity(s, F.substring(t, i, ls)))
    return (F.when(ls == 0, F.lit(0.0))
            .when(ls == lt, string_similarity(s, t))
            .otherwise(F.array_max(windows)))


def token_sort_ratio(a, b) -> Column:
    """C13 of the lower-cased, sorted, single-space joined words."""
    sa = F.array_join(F.array_sort(words(F.lower(col_(a)))), " ")
    sb = F.array_join(F.array_sort(words(F.lower(col_(b)))), " ")
    return string_similarity(sa, sb)


def token_set_ratio(a, b) -> Column:
    """C17: one C13 of (sorted common + sorted own-only) strings; both empty -> 1."""
    ta = F.array_distinct(words(F.lower(col_(a))))
    tb = F.array_distinct(words(F.lower(col_(b))))
    inter = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    da = F.array_join(F.array_sort(F.array_except(ta, tb)), " ")
    db = F.array_join(F.array_sort(F.array_except(tb, ta)), " ")
    s1 = F.when(da == "", inter).otherwise(trim_ws(F.concat(inter, F.lit(" "), da)))
    s2 = F.when(db == "", inter).otherwise(trim_ws(F.concat(inter, F.lit(" "), db)))
    return (F.when((s1 == "") & (s2 == ""), F.lit(1.0))
            .when((s1 == "") | (s2 == ""), F.lit(0.0))
            .otherwise(string_similarity(s1, s2)))


def component_similarity(a, b) -> Column:
    """Prefix 0.95, first two words 0.85, else mean of first/last C13."""
    a, b = col_(a), col_(b)
    ca, cb = name_components(a), name_components(b)
    wa, wb = words(a), words(b)
    differ = F.size(wa) != F.size(wb)
    mean = (string_similarity(ca["first"], cb["first"]) + string_similarity(ca["last"], cb["last"])) / 2.0
    return (F.when(~ca["valid"] & ~cb["valid"], F.lit(0.0))
            .when(differ & _prefix_words_equal(wa, wb), F.lit(PREFIX_COMPONENT_SCORE))
            .when(differ & _first_two_equal(wa, wb), F.lit(FIRST_TWO_COMPONENT_SCORE))
            .when(~ca["valid"] | ~cb["valid"], F.lit(0.0))
            .otherwise(mean))


def employee_scores(a, b) -> Column:
    """Struct of the five measures used by C19 and C20 (inputs normalised)."""
    a, b = col_(a), col_(b)
    return F.struct(ratio(a, b).alias("ratio"), partial_ratio(a, b).alias("partial"),
                    token_sort_ratio(a, b).alias("sort"), token_set_ratio(a, b).alias("set"),
                    component_similarity(a, b).alias("component"))


def name_similarity_from(a, b, scores: Column) -> Column:
    """C19 given :func:`employee_scores` (lets callers compute the struct once)."""
    a, b = col_(a), col_(b)
    exact = F.when(_ci_eq(a, b), F.lit(1.0)).otherwise(F.lit(0.0))
    best = F.greatest(exact, scores["ratio"], scores["partial"], scores["sort"], scores["set"], scores["component"])
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(best)


def name_similarity(a, b) -> Column:
    """max(exact, C14-C18); an empty side scores 0."""
    return name_similarity_from(a, b, employee_scores(a, b))


def employee_match_reason_from(a, b, scores: Column) -> Column:
    """C20 given :func:`employee_scores`: best measure, ties keep listed order."""
    a, b = col_(a), col_(b)
    named = [("ratio", "Basic similarity"), ("partial", "Partial match"), ("sort", "Word order similarity"),
             ("set", "Word set similarity"), ("component", "Name component match")]
    best = F.greatest(*[scores[k] for k, _ in named])
    label = F.when(scores[named[0][0]] == best, F.lit(named[0][1]))
    for k, text in named[1:]:
        label = label.when(scores[k] == best, F.lit(text))
    return F.when(_ci_eq(a, b), F.lit("Exact match")).otherwise(
        F.concat(label, F.lit(" ("), percent0(best), F.lit(")")))


def employee_match_reason(a, b) -> Column:
    return employee_match_reason_from(a, b, employee_scores(a, b))


# --- amounts (C21-C23) -----------------------------------------------------------

def amounts_zero_out(a, b) -> Column:
    """``||a|-|b|| < 0.01 and |a+b| < 0.01`` (opposite-signed totals)."""
    a, b = col_(a), col_(b)
    return (F.abs(F.abs(a) - F.abs(b)) < 0.01) & (F.abs(a + b) < 0.01)


def amount_similarity(a, b) -> Column:
    """Both 0 -> 1; one 0 -> 0; else max(0, 1 - |a-b|/max(|a|,|b|)) in doubles."""
    a, b = col_(a), col_(b)
    diff = F.abs(a - b).cast("double")
    mx = F.greatest(F.abs(a), F.abs(b)).cast("double")
    return (F.when((a == 0) & (b == 0), F.lit(1.0))
            .when((a == 0) | (b == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - diff / mx)))


def composite_score(name_sim, a, b) -> Column:
    """Name + 0.3 on equal amounts, else name x (0.3 + 0.7 x amount sim)."""
    name_sim, a, b = col_(name_sim), col_(a), col_(b)
    return F.when(F.abs(a - b) < 0.01, name_sim + EXACT_AMOUNT_BOOST).otherwise(
        name_sim * (F.lit(0.3) + F.lit(0.7) * amount_similarity(a, b)))
