"""Employee matching inside linked clients.

Work is on per-(client, employee) totals, never on rows. Candidate pairs for
the amount-aware match (D9) are generated by *lossless* amount blocking and
name bounds (``amount_join``): a composite score >= 0.6 needs either equal
amounts or the same sign with ``min/max >= 3/7``, and the further apart the
amounts, the closer the names. Names are scored only on pairs that allow it.

The greedy one-to-one assignment (D13) is order dependent: ledger employees,
in entry order, each take their best still-unused payroll employee. Clients
are folded in that order, one pass for each; a client with too many candidates
is first split into contention components, found in a number of rounds that
grows with the logarithm of the longest chain. A component too large for one
task runs as rounds of joins: a ledger employee settles on its best remaining
candidate when no earlier unsettled ledger employee still lists it. Its choice
can then no longer change, so all three ways equal the sequential fold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import (amounts_zero_out, components_similar, composite_score, employee_match_reason_from,
                                    employee_scores, first_two_words_similar, name_components,
                                    name_similarity_from, normalize_employee)
from ..functions.text import is_blank
from ..session import cut_lineage, cut_lineages
from .amount_join import PAIRS_PER_CELL, meet, profile, that_may_reach, with_bounded_scores
from .clients import with_flags
from .totals import least_amount, summed

# Fixed values (must equal the reference for identical results) -----------------
CONTEXT_THRESHOLD = 0.6          # D9 composite
NAME_ONLY_HIGH, NAME_ONLY_LOW = 0.8, 0.6   # D7 fuzzy tiers
EXTRACT_THRESHOLD = 0.8          # D8 default
SIGNIFICANT = 0.01               # P2
EXACT, NORMALIZED, COMPONENTS, FUZZY = "Exact", "Normalized", "NameComponents", "Fuzzy"
LEDGER_ONLY, PAYROLL_ONLY = "LedgerOnly", "PayrollOnly"
# ------------------------------------------------------------------------------

#: candidates that one task folds at once
FOLD_EDGES = 200_000


# --- per-client employee totals ------------------------------------------------------

def employee_totals(ledger: DataFrame, payroll: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B11 for linked clients: ledger (unified, item, qa, order) and payroll
    (unified, name, pa). A payroll client linked to several ledger clients
    is counted for each (Q1)."""
    linked = with_flags(matches).filter("is_linked").select("unified_name", "qb_name", "av_name")
    # aggregate rows to (client, employee) first, then join the aggregates to the
    # link table: a hot client never sends its rows through a join shuffle
    lagg = (ledger.groupBy("name", F.col("item").alias("l_item"))
            .agg(summed(ledger, "amount").alias("qa"), F.min(least_amount(ledger)).alias("l_o1")))
    le = (lagg.join(linked, lagg.name == linked.qb_name)
          .select("unified_name", "l_item", "qa", "l_o1", normalize_employee(F.col("l_item")).alias("l_norm")))
    pagg = payroll.groupBy("bill_to_name", F.col("name").alias("p_name")).agg(summed(payroll, "item_bill").alias("pa"))
    pe = (pagg.join(linked, pagg.bill_to_name == linked.av_name)
          .select("unified_name", "p_name", "pa", normalize_employee(F.col("p_name")).alias("p_norm")))
    return cut_lineages(le, pe)


def context_candidates(le: DataFrame, pe: DataFrame, pairs_per_cell: int = PAIRS_PER_CELL) -> DataFrame:
    """D9 pairs with composite >= 0.6: pairs meet by client, sign and amount, and are tested there by lossless bounds of the
    names and the amounts (``amount_join``); what passes is scored exactly."""
    lp = profile(le.filter(~is_blank(F.col("l_item"))), "l_norm", "qa", "l")
    pairs = that_may_reach(meet(lp, profile(pe, "p_norm", "pa", "p"), pairs_per_cell), CONTEXT_THRESHOLD)
    scored = (with_bounded_scores(pairs, CONTEXT_THRESHOLD)
              .withColumn("composite", composite_score(F.col("name_sim"), F.col("qa"), F.col("pa")))
              .filter(F.col("composite") >= CONTEXT_THRESHOLD)
              .select("unified_name", "l_item", "l_o1", "l_norm", "qa", "p_name", "p_norm", "pa", "name_sim", "composite"))
    w = Window.partitionBy("unified_name", "l_item").orderBy(
        F.col("composite").desc(), F.col("name_sim").desc(), "p_name")
    return cut_lineage(scored.withColumn("rank", F.row_number().over(w)))


def best_context_match(cands: DataFrame) -> DataFrame:
    """D9 without consumption: the top candidate of every ledger employee."""
    return cands.filter("rank = 1")


# --- D13 -----------------------------------------------------------------------

_ASSIGNED = "unified_name string, l_item string, p_name string"


def _fold(table: pa.Table) -> pa.Table:
    """The sequential pass over one bounded group: ledger employees in entry order take their best payroll employee that is left."""
    listed: dict[tuple, list[tuple]] = {}
    columns = (table.column(c).to_pylist() for c in ("unified_name", "l_o1", "l_item", "rank", "p_key", "p_name"))
    for client, o1, item, rank, key, name in zip(*columns, strict=True):
        listed.setdefault((o1 is not None, o1 or 0, item.encode("utf-8", "surrogatepass"), client, item), []).append((rank, key, name))
    used: set[str] = set()
    out = []
    for who in sorted(listed):
        for _, key, name in sorted(listed[who]):
            if key not in used:
                used.add(key)
                out.append({"unified_name": who[3], "l_item": who[4], "p_name": name})
                break
    return pa.Table.from_pylist(out, pa.schema([(c, pa.string()) for c in ("unified_name", "l_item", "p_name")]))


def connected_parts(edges: DataFrame) -> DataFrame:
    """(node, part) of an undirected graph of edges (u, v), two longs: part is the smallest node of the component. Nodes hang themselves under the smallest
    neighbour of their neighbours, then under the smallest of their own, until nothing changes; the number of rounds grows with the logarithm of the
    longest path, not with its length."""
    def settle(e: DataFrame) -> DataFrame:
        return cut_lineage(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = settle(edges)
    before = None
    while (now := state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = settle(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = settle(e.join(least, "u").select("v", F.col("m")).toDF("u", "v").unionByName(least.toDF("u", "v")))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("part"))


def greedy_assignment(cands: DataFrame, fold_edges: int = FOLD_EDGES, max_rounds: int | None = None) -> DataFrame:
    """One-to-one assignment ``(unified_name, l_item, p_name)``. Consumption is case-insensitive on the payroll name (``p_key``).

    Employees of different clients never compete, nor do those of different contention components (ledger and payroll employees
    joined by candidates) of one client. A client of at most ``fold_edges`` candidates is folded in entry order in one pass; of a larger one each
    component; only a component beyond that bound goes through the distributed rounds. ``max_rounds`` bounds those."""
    edges = cut_lineage(cands.select("unified_name", "l_item", "l_o1", "p_name", F.lower("p_name").alias("p_key"), "rank"))
    large = edges.groupBy("unified_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_edges).select("unified_name")
    large = cut_lineage(large)
    out = edges.join(large, "unified_name", "left_anti").groupBy("unified_name").applyInArrow(_fold, _ASSIGNED)
    if not large.isEmpty():
        hard = edges.join(large, "unified_name", "left_semi")
        hard = cut_lineage(hard.withColumn("u", F.xxhash64(F.lit("l"), "unified_name", "l_item")).withColumn("v", F.xxhash64(F.lit("p"), "unified_name", "p_key")))
        parts = connected_parts(hard.select("u", "v"))
        # every ledger node hangs under its part, or is the part
        hard = hard.join(parts, F.col("u") == F.col("node"), "left").withColumn("part", F.coalesce("part", "u")).drop("node", "u", "v")
        hard = cut_lineage(hard)
        giant = cut_lineage(hard.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_edges).select("part"))
        out = out.unionByName(hard.join(giant, "part", "left_anti").groupBy("part").applyInArrow(_fold, _ASSIGNED))
        rest = hard.join(giant, "part", "left_semi").drop("part")
        out = out.unionByName(_assignment_rounds(rest, max_rounds))
    return cut_lineage(out)


def _assignment_rounds(edges: DataFrame, max_rounds: int | None) -> DataFrame:
    """The assignment as rounds of joins, for components no task should hold. Rounds go on until no candidate is left; each writes
    what it settled once. If candidates are left after ``max_rounds`` this raises, it never returns a partial assignment."""
    edges = cut_lineage(edges)
    done = None
    rounds = 0
    while not edges.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"employees are left to assign after {max_rounds} rounds")
        rounds += 1
        top = (edges.groupBy("unified_name", "l_item", "l_o1")
               .agg(F.min(F.struct("rank", "p_key", "p_name")).alias("t"))
               .select("unified_name", "l_item", "l_o1", F.col("t.p_key").alias("p_key"),
                       F.col("t.p_name").alias("p_name")))
        claim = (edges.groupBy("unified_name", "p_key")
                 .agg(F.min(F.struct("l_o1", "l_item")).alias("c")))
        settled = cut_lineage(top.join(claim, ["unified_name", "p_key"])
                              .filter((F.col("c.l_o1") == F.col("l_o1")) & (F.col("c.l_item") == F.col("l_item")))
                              .select("unified_name", "l_item", "p_name", "p_key"))
        edges = cut_lineage(
            edges.join(settled.select("unified_name", "l_item"), ["unified_name", "l_item"], "left_anti")
            .join(settled.select("unified_name", "p_key"), ["unified_name", "p_key"], "left_anti"))
        done = settled if done is None else done.unionByName(settled)
        if rounds % 16 == 0:  # the union is a list of table scans: keep it short
            done = cut_lineage(done)
    if done is None:
        return edges.sparkSession.createDataFrame([], _ASSIGNED)
    return done.select("unified_name", "l_item", "p_name")


def enhanced_type(q: Column, a: Column) -> Column:
    """Exact / Normalized / Fuzzy for a matched pair."""
    return (F.when(F.lower(q) == F.lower(a), F.lit(EXACT))
            .when(F.lower(normalize_employee(q)) == F.lower(normalize_employee(a)), F.lit(NORMALIZED))
            .otherwise(F.lit(FUZZY)))


def employee_type(q: Column, a: Column) -> Column:
    """Exact / Normalized / NameComponents / Fuzzy for a matched pair."""
    nq, na = normalize_employee(q), normalize_employee(a)
    cq, ca = name_components(nq), name_components(na)
    return (F.when(F.lower(q) == F.lower(a), F.lit(EXACT))
            .when(F.lower(nq) == F.lower(na), F.lit(NORMALIZED))
            .when(cq["valid"] & ca["valid"] & components_similar(nq, na), F.lit(COMPONENTS))
            .otherwise(F.lit(FUZZY)))


def employee_matches(le: DataFrame, pe: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per linked client: every ledger employee with its assigned partner (or
    ledger-only), then payroll employees left over (case-insensitive) as
    payroll-only; later case-insensitive writes replace earlier ones (Q2)."""
    a = assigned.join(pe.select("unified_name", "p_name", "pa"), ["unified_name", "p_name"])
    led = le.join(a, ["unified_name", "l_item"], "left").select(
        "unified_name", F.col("l_item").alias("employee_name"), F.col("l_item").alias("ledger_name"),
        F.col("p_name").alias("payroll_name"), F.col("qa").alias("ledger_amount"),
        F.coalesce("pa", F.lit(0)).alias("payroll_amount"),
        F.when(F.col("p_name").isNull(), F.lit(LEDGER_ONLY)).otherwise(
            enhanced_type(F.col("l_item"), F.col("p_name"))).alias("emp_match_type"),
        F.lit(0).alias("w_side"), F.col("l_o1").alias("w_amt"), F.col("l_item").alias("w_str"))
    used = assigned.select("unified_name", F.lower("p_name").alias("p_key")).distinct()
    rest = (pe.withColumn("p_key", F.lower("p_name"))
            .join(used, ["unified_name", "p_key"], "left_anti")
            .select("unified_name", F.col("p_name").alias("employee_name"),
                    F.lit(None).cast("string").alias("ledger_name"), F.col("p_name").alias("payroll_name"),
                    F.lit(0).cast(le.schema["qa"].dataType).alias("ledger_amount"),
                    F.col("pa").alias("payroll_amount"), F.lit(PAYROLL_ONLY).alias("emp_match_type"),
                    F.lit(1).alias("w_side"), F.lit(None).cast(le.schema["l_o1"].dataType).alias("w_amt"),
                    F.col("p_name").alias("w_str")))
    w = Window.partitionBy("unified_name", F.lower("employee_name")).orderBy(
        F.col("w_side").desc(), F.col("w_amt").desc(), F.col("w_str").desc())
    out = (led.unionByName(rest).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
           .drop("rn", "w_side", "w_amt", "w_str"))
    return cut_lineage(out)


# --- D7 / D8 / D10 (name-only, over caller-supplied candidate pairs, within an optional group) ----------------

def with_name_scores(pairs: DataFrame) -> DataFrame:
    """Adds sc (the five measures) and ns of the normalised names tn, cn; each distinct pair of names is scored once."""
    names = pairs.select("tn", "cn").distinct().withColumn("sc", employee_scores(F.col("tn"), F.col("cn")))
    names = names.withColumn("ns", name_similarity_from(F.col("tn"), F.col("cn"), F.col("sc")))
    return pairs.join(names, ["tn", "cn"])


def best_by_name(pairs: DataFrame, target: str = "target", choice: str = "choice",
                 choice_order: str = "choice_ord", group: str | None = None) -> DataFrame:
    """D7 over candidate pairs ``([group,] target, choice, choice_ord)``: exact (CI) ->
    normalised -> name components -> first two words -> best similarity >= 0.8
    -> >= 0.6; ties go to the first choice. The caller decides which choices a
    target is compared with (e.g. the employees of one linked client)."""
    p = (pairs.filter(~is_blank(F.col(target)))
         .withColumn("tn", normalize_employee(F.col(target))).withColumn("cn", normalize_employee(F.col(choice))))
    tc, cc = name_components(F.col("tn")), name_components(F.col("cn"))
    p = with_name_scores(p)
    tier = (F.when(F.lower(F.col(target)) == F.lower(F.col(choice)), F.lit(1))
            .when(F.lower("tn") == F.lower("cn"), F.lit(2))
            .when(tc["valid"] & cc["valid"] & components_similar(F.col("tn"), F.col("cn")), F.lit(3))
            .when(first_two_words_similar(F.col("tn"), F.col("cn")), F.lit(4))
            .when(F.col("ns") >= NAME_ONLY_HIGH, F.lit(5))
            .when(F.col("ns") >= NAME_ONLY_LOW, F.lit(6)))
    p = p.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    score_key = F.when(F.col("tier") >= 5, -F.col("ns")).otherwise(F.lit(0.0))
    keys = [target] if group is None else [group, target]
    w = Window.partitionBy(*keys).orderBy("tier", score_key, choice_order, choice)
    return (p.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select(*keys, F.col(choice).alias("best_match"), "tier", "ns"))


def extract_best_by_name(pairs: DataFrame, threshold: float = EXTRACT_THRESHOLD, target: str = "target",
                         choice: str = "choice", choice_order: str = "choice_ord", group: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """D8 over candidate pairs: best similarity >= threshold with score and reason, for every target of ``targets``
    ([group,] target; by default those of the pairs)."""
    p = with_name_scores(pairs.withColumn("tn", normalize_employee(F.col(target))).withColumn("cn", normalize_employee(F.col(choice))))
    ok = p.withColumnRenamed("ns", "score").filter((F.col("score") >= threshold) & ~is_blank(F.col(target)))
    ok = ok.withColumn("reason", employee_match_reason_from(F.col("tn"), F.col("cn"), F.col("sc")))
    keys = [target] if group is None else [group, target]
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), choice_order, choice)
    best = ok.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        *keys, F.col(choice).alias("best_match"), "score", "reason")
    pct = int(round(threshold * 100))
    t = pairs.select(*keys).distinct() if targets is None else targets
    return t.join(best, keys, "left").select(
        *keys, "best_match", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(is_blank(F.col(target)), F.lit("Empty target"))
        .otherwise(F.coalesce("reason", F.lit(f"No match above {pct}% threshold"))).alias("reason"))


def name_only_matches(pairs: DataFrame | None, ledger_emps: DataFrame, payroll_emps: DataFrame,
                      group: str = "unified_name", best: DataFrame | None = None) -> DataFrame:
    """D10 over caller-supplied candidate pairs (or a D7 result, ``best``): every ledger employee with its
    D7 best match (no consumption) and D11 label, then payroll employees nobody
    matched (case-insensitive) as payroll-only; later case-insensitive writes
    replace earlier ones.

    ``pairs``: (group, target, choice, choice_ord); ``ledger_emps``: (group,
    name, amount, ord); ``payroll_emps``: (group, name, amount)."""
    best = best_by_name(pairs, group=group) if best is None else best
    best = best.select(group, F.col("target").alias("name"), "best_match")
    pa = payroll_emps.select(group, F.col("name").alias("best_match"), F.col("amount").alias("payroll_amount"))
    led = (ledger_emps.join(best, [group, "name"], "left").join(pa, [group, "best_match"], "left")
           .select(group, F.col("name").alias("employee_name"), F.col("name").alias("ledger_name"),
                   F.col("best_match").alias("payroll_name"), F.col("amount").alias("ledger_amount"),
                   F.coalesce("payroll_amount", F.lit(0)).alias("payroll_amount"),
                   F.when(F.col("best_match").isNull(), F.lit(LEDGER_ONLY))
                   .otherwise(employee_type(F.col("name"), F.col("best_match"))).alias("emp_match_type"),
                   F.lit(0).alias("w_side"), F.col("ord").alias("w_ord"), F.lit(None).cast("string").alias("w_name")))
    used = best.filter(F.col("best_match").isNotNull()).select(group, F.lower("best_match").alias("k")).distinct()
    rest = (payroll_emps.withColumn("k", F.lower("name")).join(used, [group, "k"], "left_anti")
            .select(group, F.col("name").alias("employee_name"), F.lit(None).cast("string").alias("ledger_name"),
                    F.col("name").alias("payroll_name"), F.lit(0).alias("ledger_amount"),
                    F.col("amount").alias("payroll_amount"), F.lit(PAYROLL_ONLY).alias("emp_match_type"),
                    F.lit(1).alias("w_side"), F.lit(None).cast(ledger_emps.schema["ord"].dataType).alias("w_ord"),
                    F.col("name").alias("w_name")))
    w = Window.partitionBy(group, F.lower("employee_name")).orderBy(
        F.col("w_side").desc(), F.col("w_ord").desc(), F.col("w_name").desc())
    return (led.unionByName(rest).withColumn("rn", F.row_number().over(w))
            .filter("rn = 1").drop("rn", "w_side", "w_ord", "w_name"))
