"""Client linking across the two extracts.

Everything runs on *distinct client names* (a per-name aggregate of the
rows), never on rows. The tiered search for each ledger client is expressed
as one union of candidate pairs tagged with their tier, and a single
``row_number`` window per ledger name picks the first tier, the best score
and then the first payroll client in entry order - the "first tier that
yields" of the source, without its per-name loop over all candidates.

* tier 1  rule -> exact (case-insensitive) on the mapped name   (equi join)
* tier 2  rule -> best raw similarity to the mapped name >= 0.75 (blocked)
* tier 3  exact case-insensitive name                            (equi join)
* tier 4  totals zero out and normalised similarity >= 0.3       (equi join on -total)
* tier 5  best normalised similarity >= 0.5                      (blocked)

Later tiers only see names earlier tiers left unresolved (``left_anti``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import (amounts_zero_out, client_match_reason, client_similarity, first_n_words,
                                    normalize_client)
from .blocking import best_similar
from ..functions.text import is_blank
from ..session import cut_lineage, cut_lineages
from .sizing import broadcast_if_small
from .totals import least_amount, summed

# Fixed values (must equal the reference for identical results) -----------------
RULE_FUZZY_THRESHOLD = 0.75
ZERO_OUT_NAME_THRESHOLD = 0.3
FUZZY_THRESHOLD = 0.5
EXTRACT_THRESHOLD = 0.7
NO_PAYMENT_METHOD = "Research pymt method"
# Default exception rules (each also applies in reverse).
DEFAULT_RULES = [
    ("Complete Mechanical Services", "CMS- Complete Mechanical Services"),
    ("LCI", "Lippert"),
    ("JBI Electrical Systems", "OWL Services (JBI Electrical Systems Inc.)"),
    ("TJ Maxx ARRC", "TJX Companies"),
    ("Carl Nelson & Company", "Carl A Nelson"),
    ("Elgin Separation Solutions", "Elgin Power Solutions"),
    ("Gaylor Electric", "Gaylor Group"),
    ("InPwr Inc", "In Pwr Inc"),
]
# Match-type labels (the two one-sided types use our neutral side names).
EXACT, RULE, ZERO_OUT, NORMALIZED, FIRST_WORDS, FUZZY = (
    "Exact", "ExceptionRule", "AmountZeroOut", "Normalized", "FirstWords", "Fuzzy")
LEDGER_ONLY, PAYROLL_ONLY = "LedgerOnly", "PayrollOnly"
MATCH_NOTES = {
    RULE: "Matched via exception rule",
    ZERO_OUT: "Matched via amounts that zero out + similar names (likely same client)",
    NORMALIZED: "Matched after name normalization",
    FIRST_WORDS: "Matched on first words",
    FUZZY: "Fuzzy match (contains)",
    LEDGER_ONLY: "Ledger only - no payroll match",
    PAYROLL_ONLY: "Payroll only - no ledger match",
}
# ------------------------------------------------------------------------------


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(DEFAULT_RULES)],
                                 "row_no int, name_a string, name_b string")


# --- D1 -------------------------------------------------------------------------

def bidirectional_rules(rules: DataFrame) -> DataFrame:
    """(key, mapped) in both directions; a later write for the same
    case-insensitive key wins (writes go rule by rule, forward then reverse)."""
    both = (rules.select(F.col("name_a").alias("key"), F.col("name_b").alias("mapped"),
                         (F.col("row_no").cast("long") * 2).alias("seq"))
            .unionByName(rules.select(F.col("name_b").alias("key"), F.col("name_a").alias("mapped"),
                                      (F.col("row_no").cast("long") * 2 + 1).alias("seq"))))
    w = Window.partitionBy(F.lower("key")).orderBy(F.col("seq").desc())
    return (both.filter(F.col("key").isNotNull() & F.col("mapped").isNotNull())
            .withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select(F.lower("key").alias("rule_key"), "mapped"))


# --- per-client aggregates ---------------------------------------------------------

def ledger_clients(ledger: DataFrame, materialize: bool = True) -> DataFrame:
    """Distinct ledger clients with total, normalised name and entry-order key
    (G1: the source sorts rows by amount, item, name; a client's position is
    its first row), from cleaned rows or their totals. One row per client: checkpointed, because every matching
    tier reads it and the row-level lineage behind it is long."""
    out = (ledger.groupBy(F.col("name").alias("qb_name"))
           .agg(summed(ledger, "amount").alias("qb_total"), F.min(F.struct(least_amount(ledger), "item")).alias("o"))
           .select("qb_name", "qb_total", F.col("o.amount").alias("qb_o1"), F.col("o.item").alias("qb_o2"),
                   normalize_client(F.col("qb_name")).alias("qb_norm")))
    return cut_lineage(out) if materialize else out


def payroll_clients(payroll: DataFrame, materialize: bool = True) -> DataFrame:
    """Distinct payroll clients with total, normalised name and entry-order key
    (G2: rows sorted by employee name, then bill-to), from cleaned rows or their totals."""
    out = (payroll.groupBy(F.col("bill_to_name").alias("av_name"))
           .agg(summed(payroll, "item_bill").alias("av_total"), F.min("name").alias("av_o1"))
           .withColumn("av_norm", normalize_client(F.col("av_name"))))
    return cut_lineage(out) if materialize else out


# --- D2 -------------------------------------------------------------------------

def _scored(pairs: DataFrame, tier: int, score: Column) -> DataFrame:
    return pairs.select("qb_name", "av_name", F.lit(tier).alias("tier"), score.alias("score"))


def _fuzzy_best(lnames: DataFrame, lstr: str, pnames: DataFrame, pstr: str, floor: float) -> DataFrame:
    """The best pairs of each left name at or above ``floor`` (staged join over distinct strings), joined back to the names, with ``score``."""
    ls = lnames.select(F.col(lstr).alias("s")).distinct().select(F.col("s").alias("id"), "s")
    ps = pnames.select(F.col(pstr).alias("s")).distinct().select(F.col("s").alias("id"), "s")
    best = best_similar(ls, ps, floor)
    return (best.join(lnames, best.l == lnames[lstr]).join(pnames, best.r == pnames[pstr])
            .drop("l", "r"))


def best_payroll_client(lc: DataFrame, pc: DataFrame, rules: DataFrame) -> DataFrame:
    """D2 for every ledger client: ``qb_name, av_name, tier, score`` (matched only)."""
    lc = lc.filter(F.col("qb_name") != "")
    pcs = pc.select("av_name", "av_total", "av_o1", F.lower("av_name").alias("av_low"), "av_norm")
    rb = broadcast_if_small(bidirectional_rules(rules), 100_000)
    ruled = cut_lineage(lc.join(rb, F.lower(lc.qb_name) == rb.rule_key).select("qb_name", "mapped"))

    t1 = cut_lineage(_scored(ruled.join(pcs, F.lower(ruled.mapped) == pcs.av_low), 1, F.lit(1.0)))
    ruled_left = cut_lineage(ruled.join(t1.select("qb_name"), "qb_name", "left_anti"))
    if ruled_left.isEmpty():   # nothing left for the rule-fuzzy tier: skip its blocking joins
        t2 = t1.limit(0)
    else:
        t2 = _scored(_fuzzy_best(ruled_left, "mapped", pcs, "av_name", RULE_FUZZY_THRESHOLD), 2, F.col("score"))
    t3 = _scored(lc.join(pcs, F.lower(lc.qb_name) == pcs.av_low), 3, F.lit(1.0))
    early = cut_lineage(t1.unionByName(t2).unionByName(t3))

    # stage boundaries are checkpointed: each later tier reads the earlier ones
    rest = cut_lineage(lc.join(early.select("qb_name"), "qb_name", "left_anti"))
    z = rest.join(pcs, rest.qb_total == -pcs.av_total)
    t4 = _scored(z, 4, client_similarity(F.col("qb_norm"), F.col("av_norm")))
    t4 = cut_lineage(t4.filter(F.col("score") >= ZERO_OUT_NAME_THRESHOLD))

    rest5 = cut_lineage(rest.join(t4.select("qb_name"), "qb_name", "left_anti"))
    if rest5.isEmpty():
        t5 = t4.limit(0)
    else:
        t5 = cut_lineage(_scored(_fuzzy_best(rest5, "qb_norm", pcs, "av_norm", FUZZY_THRESHOLD), 5, F.col("score")))

    cand = early.unionByName(t4).unionByName(t5).join(pc.select("av_name", "av_o1"), "av_name")
    w = Window.partitionBy("qb_name").orderBy("tier", F.col("score").desc(), "av_o1", "av_name")
    return cut_lineage(cand.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "av_o1"))


# --- D5 / D15 -----------------------------------------------------------------------

def match_type(qb: Column, av: Column, mapped: Column, qb_total: Column, av_total: Column,
               nq: Column | None = None, na: Column | None = None, fq: Column | None = None,
               fa: Column | None = None) -> Column:
    """Label of a linked pair (independent of the tier that linked it).
    Pass precomputed normalised names / first words to keep the plan small."""
    nq = normalize_client(qb) if nq is None else nq
    na = normalize_client(av) if na is None else na
    fq = first_n_words(nq) if fq is None else fq
    fa = first_n_words(na) if fa is None else fa
    similar = ((F.lower(nq) == F.lower(na)) | ((fq != "") & (fa != "") & (F.lower(fq) == F.lower(fa)))
               | ((F.length(nq) > 3) & (F.instr(F.lower(na), F.lower(nq)) > 0))
               | ((F.length(na) > 3) & (F.instr(F.lower(nq), F.lower(na)) > 0)))
    return (F.when(F.lower(qb) == F.lower(av), F.lit(EXACT))
            .when(mapped.isNotNull() & (F.lower(mapped) == F.lower(av)), F.lit(RULE))
            .when(amounts_zero_out(qb_total, av_total) & similar, F.lit(ZERO_OUT))
            .when(F.lower(nq) == F.lower(na), F.lit(NORMALIZED))
            .when((fq != "") & (F.lower(fq) == F.lower(fa)), F.lit(FIRST_WORDS))
            .otherwise(F.lit(FUZZY)))


def match_notes(mt: Column) -> Column:
    """Note text per match type; Exact -> ''."""
    out = F.lit("")
    for k, v in MATCH_NOTES.items():
        out = F.when(mt == k, F.lit(v)).otherwise(out)
    return out


# --- D4 -------------------------------------------------------------------------

@dataclass
class ClientMatch:
    """D4 result plus the per-client aggregates it was built from."""
    matches: DataFrame        # unified_name, qb_name, av_name, match_type, qb_total, av_total
    ledger_clients: DataFrame
    payroll_clients: DataFrame


def unified_matches(ledger: DataFrame, payroll: DataFrame, rules: DataFrame) -> ClientMatch:
    """Every ledger client with its D2 partner (or ledger-only), then the
    payroll clients nobody linked (case-insensitive) as payroll-only. Keys are
    case-insensitive and a later write replaces an earlier one: ledger names
    in entry order, then payroll names in entry order."""
    lc, pc = cut_lineages(ledger_clients(ledger, materialize=False), payroll_clients(payroll, materialize=False))
    best = best_payroll_client(lc, pc, rules)
    rb = broadcast_if_small(bidirectional_rules(rules), 100_000)
    led = (lc.join(best.select("qb_name", "av_name"), "qb_name", "left")
           .join(pc.select("av_name", "av_total", "av_norm"), "av_name", "left")
           .join(rb, F.lower(F.col("qb_name")) == rb.rule_key, "left")
           .withColumn("fq", first_n_words("qb_norm")).withColumn("fa", first_n_words("av_norm")))
    led = led.select(
        F.col("qb_name").alias("unified_name"), "qb_name", "av_name",
        F.when(F.col("av_name").isNull(), F.lit(LEDGER_ONLY)).otherwise(
            match_type(F.col("qb_name"), F.col("av_name"), F.col("mapped"), F.col("qb_total"),
                       F.col("av_total"), F.col("qb_norm"), F.col("av_norm"), F.col("fq"),
                       F.col("fa"))).alias("match_type"),
        "qb_total", "av_total", F.lit(0).alias("w_side"), F.col("qb_o1").alias("w_amt"),
        F.col("qb_o2").alias("w_str"))
    used = led.filter(F.col("av_name").isNotNull()).select(F.lower("av_name").alias("used")).distinct()
    left_over = pc.join(used, F.lower(pc.av_name) == used.used, "left_anti").select(
        F.col("av_name").alias("unified_name"), F.lit(None).cast("string").alias("qb_name"), "av_name",
        F.lit(PAYROLL_ONLY).alias("match_type"), F.lit(None).cast(lc.schema["qb_total"].dataType).alias("qb_total"),
        "av_total", F.lit(1).alias("w_side"), F.lit(None).cast(lc.schema["qb_o1"].dataType).alias("w_amt"),
        F.col("av_o1").alias("w_str"))
    allm = led.unionByName(left_over)
    w = Window.partitionBy(F.lower("unified_name")).orderBy(
        F.col("w_side").desc(), F.col("w_amt").desc(), F.col("w_str").desc(), F.col("unified_name").desc())
    final = allm.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "unified_name", "qb_name", "av_name", "match_type", "qb_total", "av_total")
    return ClientMatch(cut_lineage(final), lc, pc)


def with_flags(matches: DataFrame) -> DataFrame:
    """has_ledger / has_payroll / is_linked flags (non-empty names)."""
    hq = F.coalesce(F.col("qb_name"), F.lit("")) != ""
    ha = F.coalesce(F.col("av_name"), F.lit("")) != ""
    return matches.withColumn("has_ledger", hq).withColumn("has_payroll", ha).withColumn("is_linked", hq & ha)


# --- D3 -------------------------------------------------------------------------

def best_ledger_client(lc: DataFrame, pc: DataFrame, rules: DataFrame) -> DataFrame:
    """D3 (reverse lookup): for each payroll client the first ledger client by
    rule (exact, then raw similarity >= 0.75), exact, normalised-equal,
    first-two-words-equal, then containment of normalised names. Ties go to
    the first ledger client in entry order."""
    pcx = pc.filter(F.col("av_name") != "")
    lcs = lc.select("qb_name", "qb_o1", "qb_o2", "qb_norm")
    rb = broadcast_if_small(bidirectional_rules(rules), 100_000)
    ruled = pcx.join(rb, F.lower(pcx.av_name) == rb.rule_key).select("av_name", "mapped")
    t1 = ruled.join(lcs, F.lower(ruled.mapped) == F.lower(lcs.qb_name)).select(
        "av_name", "qb_name", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    fz = _fuzzy_best(ruled.join(t1.select("av_name"), "av_name", "left_anti"), "mapped",
                     lcs, "qb_name", RULE_FUZZY_THRESHOLD)
    t2 = fz.select("av_name", "qb_name", F.lit(2).alias("tier"), "score")
    t3 = pcx.join(lcs, F.lower(pcx.av_name) == F.lower(lcs.qb_name)).select(
        "av_name", "qb_name", F.lit(3).alias("tier"), F.lit(1.0).alias("score"))
    t4 = pcx.join(lcs, F.lower(pcx.av_norm) == F.lower(lcs.qb_norm)).select(
        "av_name", "qb_name", F.lit(4).alias("tier"), F.lit(1.0).alias("score"))
    pf = pcx.withColumn("fw", F.lower(first_n_words("av_norm"))).filter("fw <> ''")
    lf = lcs.withColumn("fw", F.lower(first_n_words("qb_norm"))).filter("fw <> ''")
    t5 = pf.join(lf, "fw").select("av_name", "qb_name", F.lit(5).alias("tier"), F.lit(1.0).alias("score"))
    # containment either way (empty normalised names are contained in everything)
    from .blocking import contains_candidates
    ps = pcx.select(F.col("av_norm").alias("s")).distinct().select(F.col("s").alias("id"), "s")
    ls = lcs.select(F.col("qb_norm").alias("s")).distinct().select(F.col("s").alias("id"), "s")
    cc = contains_candidates(ps, ls, min_len=1).distinct()
    cpairs = (cc.join(pcx, cc.l == pcx.av_norm).join(lcs, cc.r == lcs.qb_norm)
              .filter((F.instr(F.lower("qb_norm"), F.lower("av_norm")) > 0)
                      | (F.instr(F.lower("av_norm"), F.lower("qb_norm")) > 0)))
    # an empty normalised name is contained in every name: only the first
    # ledger client in entry order can win, so join that single row
    first_lc = lcs.agg(F.min(F.struct("qb_o1", "qb_o2", "qb_name")).alias("f")).select(
        F.col("f.qb_name").alias("qb_name"), F.lit(1).alias("k"))
    first_empty = lcs.filter(F.col("qb_norm") == "").agg(
        F.min(F.struct("qb_o1", "qb_o2", "qb_name")).alias("f")).select(
        F.col("f.qb_name").alias("qb_name"), F.lit(1).alias("k")).filter(F.col("qb_name").isNotNull())
    # both sides joined to are global aggregates: exactly one row, so broadcasting is bounded
    e1 = pcx.filter(F.col("av_norm") == "").select("av_name", F.lit(1).alias("k")).join(F.broadcast(first_lc), "k")
    e2 = pcx.select("av_name", F.lit(1).alias("k")).join(F.broadcast(first_empty), "k")
    t6 = (cpairs.select("av_name", "qb_name").unionByName(e1.select("av_name", "qb_name"))
          .unionByName(e2.select("av_name", "qb_name"))
          .select("av_name", "qb_name", F.lit(6).alias("tier"), F.lit(1.0).alias("score")))
    cand = (t1.unionByName(t2).unionByName(t3).unionByName(t4).unionByName(t5).unionByName(t6)
            .join(lcs.select("qb_name", "qb_o1", "qb_o2"), "qb_name"))
    w = Window.partitionBy("av_name").orderBy("tier", F.col("score").desc(), "qb_o1", "qb_o2", "qb_name")
    return (cand.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("av_name", "qb_name", "tier"))


# --- D6 -------------------------------------------------------------------------

def extract_best_client(targets: DataFrame, choices: DataFrame, threshold: float = EXTRACT_THRESHOLD,
                        target_col: str = "target", choice_col: str = "choice", order_cols=()) -> DataFrame:
    """Best choice per target by normalised client similarity >= threshold,
    with score and reason; targets with none get a null match and score 0."""
    t = targets.select(F.col(target_col).alias("target")).distinct().withColumn("t_norm", normalize_client("target"))
    c = choices.select(F.col(choice_col).alias("choice"), *order_cols).withColumn("c_norm", normalize_client("choice"))
    tl = t.filter(~is_blank(F.col("target")))
    pairs = _fuzzy_best(tl, "t_norm", c, "c_norm", threshold)
    scored = pairs.select("target", "choice", *order_cols, "score",
                          client_match_reason(F.col("t_norm"), F.col("c_norm")).alias("reason"))
    w = Window.partitionBy("target").orderBy(F.col("score").desc(), *order_cols, "choice")
    best = scored.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", *order_cols)
    pct = int(round(threshold * 100))
    return t.join(best, "target", "left").select(
        "target", F.col("choice").alias("best_match"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(is_blank(F.col("target")), F.lit("Empty target"))
        .otherwise(F.coalesce("reason", F.lit(f"No match above {pct}% threshold"))).alias("reason"))
