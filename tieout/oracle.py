"""DuckDB oracle SQL for every registered query.

This is an independent, brute-force restatement of each operator in plain
SQL: no blocking, no pruning, every candidate pair scored. It runs on the
same driver tables through the shared fixture SQL. The ``*_sql`` helpers
return SQL expression text (DuckDB dialect) for the scalar functions.
"""

from __future__ import annotations

from .plans.inputs import F_ANNOTATIONS
from .sources.fixtures import fixture_ctes

# --- cleaned inputs -------------------------------------------------------------

O_LEDGER = """
SELECT trim(regexp_replace(n, ':.*|--.*', '', 'g')) AS name, trim(regexp_replace(n, '.*?:|.*?--', '', 'g')) AS memo,
  trim(coalesce(item, '')) AS item, parsed AS amount, trim(type) AS type, trim(coalesce(account, '')) AS account,
  trim(coalesce(rep, '')) AS rep, trim(coalesce(po_number, '')) AS po_number
FROM (SELECT *, trim(coalesce(name, '')) AS n, TRY_CAST(trim(amount_text) AS DECIMAL(18,2)) AS parsed FROM f_ledger
      WHERE trim(coalesce(type, '')) <> '') x
WHERE parsed IS NOT NULL
"""

O_PAYROLL = """
SELECT trim(coalesce(first_name, '')) || ' ' || trim(coalesce(last_name, '')) AS name,
  CASE WHEN starts_with(lower(trim(coalesce(bill_to_name, ''))), 'dart entities') THEN 'Dart Entities'
       ELSE trim(coalesce(bill_to_name, '')) END AS bill_to_name,
  CAST(item_bill AS DECIMAL(18,2)) AS item_bill, CAST(item_pay AS DECIMAL(18,2)) AS item_pay,
  CAST(week_worked AS DATE) AS week_worked
FROM f_payroll WHERE item_bill IS NOT NULL AND item_pay IS NOT NULL AND week_worked IS NOT NULL
"""

O_DEPOSITS_TYPED = """
SELECT trim(coalesce(client_name, '')) AS client_name, trim(coalesce(num, '')) AS num,
  TRY_CAST(trim(amount_text) AS DECIMAL(18,2)) AS amount, TRY_CAST(deposit_date AS DATE) AS deposit_date, row_idx
FROM f_deposits WHERE trim(coalesce(type, '')) <> ''
"""

O_DEPOSITS = """
SELECT client_name, CASE WHEN num <> '' THEN 'Check' ELSE 'ACH' END AS payment_method, amount, deposit_date,
  num AS check_number, row_idx
FROM o_deposits_typed
WHERE row_idx < coalesce((SELECT min(row_idx) FROM o_deposits_typed WHERE amount IS NULL OR deposit_date IS NULL),
                         9223372036854775807)
"""

CLEAN_CTES = [("o_ledger", O_LEDGER), ("o_payroll", O_PAYROLL), ("o_deposits_typed", O_DEPOSITS_TYPED),
              ("o_deposits", O_DEPOSITS), ("o_annotations", F_ANNOTATIONS)]


def with_inputs(extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    return fixture_ctes(CLEAN_CTES + list(extra or []), recursive=recursive)


# --- scalar function text ---------------------------------------------------------

def words_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def norm_client_sql(x: str) -> str:
    s = (f"regexp_replace(trim({x}), '(?i)\\b(LLC|Inc\\.?|Corp\\.?|Corporation|Company|Co\\.?|Ltd\\.?|Limited)\\b',"
         f" '', 'g')")
    s = f"regexp_replace({s}, '[^\\w\\s]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def norm_emp_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '[-_.]+', ' ', 'g')"
    s = f"regexp_replace({s}, '[^\\w\\s]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def first2_sql(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN '' ELSE array_to_string({words_sql(x)}[1:2], ' ') END"


def lev_ratio_sql(a: str, b: str) -> str:
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 "
            f"ELSE 1.0 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END")


def client_sim_sql(a: str, b: str) -> str:
    fa, fb = first2_sql(a), first2_sql(b)
    fw = f"(CASE WHEN {fa} <> '' AND {fb} <> '' AND lower({fa}) = lower({fb}) THEN 0.85 ELSE 0.0 END)"
    ct = (f"(CASE WHEN length({a}) >= 3 AND length({b}) >= 3 AND (strpos(lower({a}), lower({b})) > 0 "
          f"OR strpos(lower({b}), lower({a})) > 0) THEN 0.75 ELSE 0.0 END)")
    ex = f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0 ELSE 0.0 END)"
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE "
            f"greatest({ex}, {lev_ratio_sql(a, b)}, {fw}, {ct}) END)")


def str_sim_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE "
            f"1.0 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END)")


def partial_sql(a: str, b: str) -> str:
    s = f"(CASE WHEN length({a}) <= length({b}) THEN lower({a}) ELSE lower({b}) END)"
    t = f"(CASE WHEN length({a}) <= length({b}) THEN lower({b}) ELSE lower({a}) END)"
    win = (f"list_max(list_transform(range(1, length({t}) - length({s}) + 2), "
           f"lambda i: {str_sim_sql(s, f'substr({t}, i, length({s}))')}))")
    return (f"(CASE WHEN length({s}) = 0 THEN 0.0 WHEN length({s}) = length({t}) THEN {str_sim_sql(s, t)} "
            f"ELSE {win} END)")


def sort_sql(a: str, b: str) -> str:
    sa = f"array_to_string(list_sort({words_sql(f'lower({a})')}), ' ')"
    sb = f"array_to_string(list_sort({words_sql(f'lower({b})')}), ' ')"
    return str_sim_sql(sa, sb)


def set_sql(a: str, b: str) -> str:
    ta, tb = f"list_distinct({words_sql(f'lower({a})')})", f"list_distinct({words_sql(f'lower({b})')})"
    inter = f"array_to_string(list_sort(list_filter({ta}, lambda z: list_contains({tb}, z))), ' ')"
    da = f"array_to_string(list_sort(list_filter({ta}, lambda z: NOT list_contains({tb}, z))), ' ')"
    db = f"array_to_string(list_sort(list_filter({tb}, lambda z: NOT list_contains({ta}, z))), ' ')"
    s1 = f"(CASE WHEN {da} = '' THEN {inter} ELSE trim({inter} || ' ' || {da}) END)"
    s2 = f"(CASE WHEN {db} = '' THEN {inter} ELSE trim({inter} || ' ' || {db}) END)"
    return (f"(CASE WHEN {s1} = '' AND {s2} = '' THEN 1.0 WHEN {s1} = '' OR {s2} = '' THEN 0.0 "
            f"ELSE {str_sim_sql(s1, s2)} END)")


def comp_sql(a: str, b: str) -> str:
    wa, wb = words_sql(a), words_sql(b)
    la, lb = f"list_transform({wa}, lambda x: lower(x))", f"list_transform({wb}, lambda x: lower(x))"
    na, nb = f"len({wa})", f"len({wb})"
    va, vb = f"({na} >= 2)", f"({nb} >= 2)"
    prefix = f"(CASE WHEN {na} < {nb} THEN {lb}[1:{na}] = {la} ELSE {la}[1:{nb}] = {lb} END)"
    two = f"({na} >= 2 AND {nb} >= 2 AND {la}[1] = {lb}[1] AND {la}[2] = {lb}[2])"
    mean = (f"({str_sim_sql(f'{wa}[1]', f'{wb}[1]')} + "
            f"{str_sim_sql(f'{wa}[{na}]', f'{wb}[{nb}]')}) / 2.0")
    return (f"(CASE WHEN NOT {va} AND NOT {vb} THEN 0.0 "
            f"WHEN {na} <> {nb} AND {prefix} THEN 0.95 WHEN {na} <> {nb} AND {two} THEN 0.85 "
            f"WHEN NOT {va} OR NOT {vb} THEN 0.0 ELSE {mean} END)")


def name_sim_sql(a: str, b: str) -> str:
    ex = f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0 ELSE 0.0 END)"
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE greatest({ex}, {str_sim_sql(a, b)}, "
            f"{partial_sql(a, b)}, {sort_sql(a, b)}, {set_sql(a, b)}, {comp_sql(a, b)}) END)")


def amount_sim_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0 WHEN {a} = 0 OR {b} = 0 THEN 0.0 ELSE "
            f"greatest(0.0, 1.0 - CAST(abs({a} - {b}) AS DOUBLE) / CAST(greatest(abs({a}), abs({b})) AS DOUBLE)) END)")


def composite_sql(ns: str, a: str, b: str) -> str:
    return (f"(CASE WHEN abs({a} - {b}) < 0.01 THEN {ns} + 0.3 "
            f"ELSE {ns} * (0.3 + 0.7 * {amount_sim_sql(a, b)}) END)")


def zero_out_sql(a: str, b: str) -> str:
    return f"(abs(abs({a}) - abs({b})) < 0.01 AND abs({a} + {b}) < 0.01)"


def pct_sql(x: str) -> str:
    return f"CAST(CAST(round({x} * 100) AS BIGINT) AS VARCHAR) || '%'"


def n2_sql(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def currency_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({x}) AS DOUBLE)))"


# --- pivots -----------------------------------------------------------------------

def _flat_sql(src: str, keys: list[str], measure: str, cnt: str = "count(*)", where: str = "") -> str:
    k = ", ".join(keys)
    key = " || ' - ' || ".join(keys)
    return (with_inputs() + f"SELECT {key} AS key, {k}, CAST(sum({measure}) AS DECIMAL(18,2)) AS amount, "
            f"count(*) AS quantity, {cnt} AS cnt FROM {src} {where} GROUP BY {k}")


def _tree_sql(src: str, parent: str, child: str, measure: str, where: str = "") -> str:
    kids = (f"SELECT {parent} AS g, {child} AS k, CAST(sum({measure}) AS DECIMAL(18,2)) AS amount, count(*) AS cnt "
            f"FROM {src} {where} GROUP BY {parent}, {child}")
    return (with_inputs([("kids", kids)]) +
            "SELECT 'group' AS level, g AS group_name, CAST(NULL AS VARCHAR) AS key, "
            "CAST(sum(amount) AS DECIMAL(18,2)) AS amount, sum(cnt)::BIGINT AS quantity, sum(cnt)::BIGINT AS cnt, "
            "count(*) AS n_children FROM kids GROUP BY g "
            "UNION ALL SELECT 'item', g, k, amount, cnt, cnt, CAST(NULL AS BIGINT) FROM kids")


def pivot_sql() -> dict[str, str]:
    tree_b6 = _tree_sql("o_ledger", "name", "item", "amount")
    return {
        "a1_ledger_clean": with_inputs() + "SELECT * FROM o_ledger",
        "a2_payroll_clean": with_inputs() + "SELECT * FROM o_payroll",
        "a3_deposits_clean": with_inputs() + "SELECT * FROM o_deposits",
        "b1_ledger_client_item": _flat_sql("o_ledger", ["name", "item"], "amount"),
        "b2_ledger_rep_client": _flat_sql("o_ledger", ["rep", "name"], "amount", where="WHERE rep <> ''"),
        "b3_ledger_invoices": _flat_sql("o_ledger", ["name"], "amount", cnt="count(DISTINCT type)"),
        "b4_ledger_employee_job_site": _flat_sql("o_ledger", ["item", "memo"], "amount", where="WHERE memo <> ''"),
        "b5_payroll_bill_to_employee": _flat_sql("o_payroll", ["bill_to_name", "name"], "item_bill"),
        "b6_ledger_client_item_tree": tree_b6,
        "b7_ledger_rep_client_tree": _tree_sql("o_ledger", "rep", "name", "amount", where="WHERE rep <> ''"),
        "b8_payroll_bill_to_tree": _tree_sql("o_payroll", "bill_to_name", "name", "item_bill"),
    }


# --- clients (D1-D6, E1) ---------------------------------------------------------------

def client_ctes() -> list[tuple[str, str]]:
    """Brute-force client linking: every (ledger, payroll) pair is scored."""
    nq, na = norm_client_sql("qb_name"), norm_client_sql("av_name")
    sim_m = client_sim_sql("mapped", "av_name")
    sim_n = client_sim_sql("qb_norm", "av_norm")
    return [
        ("lc0", "SELECT name AS qb_name, sum(amount) AS qb_total, min(amount) AS qb_o1 FROM o_ledger GROUP BY name"),
        ("lc", "SELECT l.qb_name, l.qb_total, l.qb_o1, min(o.item) AS qb_o2 FROM lc0 l JOIN o_ledger o "
               "ON o.name = l.qb_name AND o.amount = l.qb_o1 GROUP BY ALL"),
        ("pc", "SELECT bill_to_name AS av_name, sum(item_bill) AS av_total, min(name) AS av_o1 FROM o_payroll "
               "GROUP BY bill_to_name"),
        ("rb", "SELECT lower(key) AS rule_key, mapped FROM (SELECT key, mapped, row_number() OVER "
               "(PARTITION BY lower(key) ORDER BY seq DESC) AS rn FROM (SELECT name_a AS key, name_b AS mapped, "
               "CAST(row_no AS BIGINT) * 2 AS seq FROM f_rules UNION ALL SELECT name_b, name_a, "
               "CAST(row_no AS BIGINT) * 2 + 1 FROM f_rules) r WHERE key IS NOT NULL AND mapped IS NOT NULL) x "
               "WHERE rn = 1"),
        ("lcx", f"SELECT lc.*, rb.mapped, {nq} AS qb_norm FROM lc LEFT JOIN rb ON lower(lc.qb_name) = rb.rule_key"),
        ("pcx", f"SELECT pc.*, {na} AS av_norm FROM pc"),
        ("ccand", f"""
SELECT qb_name, av_name, 1 AS tier, 1.0 AS score FROM lcx JOIN pcx ON lower(mapped) = lower(av_name)
  WHERE qb_name <> '' AND mapped IS NOT NULL
UNION ALL SELECT qb_name, av_name, 2, {sim_m} FROM lcx, pcx
  WHERE qb_name <> '' AND mapped IS NOT NULL AND {sim_m} >= 0.75
UNION ALL SELECT qb_name, av_name, 3, 1.0 FROM lcx JOIN pcx ON lower(qb_name) = lower(av_name) WHERE qb_name <> ''
UNION ALL SELECT qb_name, av_name, 4, {sim_n} FROM lcx, pcx
  WHERE qb_name <> '' AND {zero_out_sql('qb_total', 'av_total')} AND {sim_n} >= 0.3
UNION ALL SELECT qb_name, av_name, 5, {sim_n} FROM lcx, pcx WHERE qb_name <> '' AND {sim_n} >= 0.5"""),
        ("cbest", "SELECT qb_name, av_name, tier, score FROM (SELECT c.*, row_number() OVER (PARTITION BY c.qb_name "
                  "ORDER BY c.tier, c.score DESC, pc.av_o1, c.av_name) AS rn FROM ccand c JOIN pc USING (av_name)) x "
                  "WHERE rn = 1"),
        ("cled", f"""
SELECT l.qb_name AS unified_name, l.qb_name, b.av_name, l.qb_total, p.av_total, l.mapped,
  0 AS w_side, l.qb_o1 AS w_amt, l.qb_o2 AS w_str
FROM lcx l LEFT JOIN cbest b USING (qb_name) LEFT JOIN pc p ON p.av_name = b.av_name"""),
        ("cleft", """
SELECT pc.av_name AS unified_name, CAST(NULL AS VARCHAR) AS qb_name, pc.av_name, CAST(NULL AS DECIMAL(38,2)) AS qb_total,
  pc.av_total, CAST(NULL AS VARCHAR) AS mapped, 1 AS w_side, CAST(NULL AS DECIMAL(38,2)) AS w_amt, pc.av_o1 AS w_str
FROM pc WHERE lower(pc.av_name) NOT IN (SELECT lower(av_name) FROM cled WHERE av_name IS NOT NULL)"""),
        ("cmatch0", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(unified_name) ORDER BY w_side DESC, "
                    "w_amt DESC NULLS LAST, w_str DESC, unified_name DESC) AS rn FROM (SELECT * FROM cled UNION ALL "
                    "SELECT * FROM cleft) u) x WHERE rn = 1"),
        ("cmatch!", f"SELECT unified_name, qb_name, av_name, {match_type_sql()} AS match_type, qb_total, av_total "
                   "FROM cmatch0"),
    ]


def match_type_sql() -> str:
    nq, na = norm_client_sql("qb_name"), norm_client_sql("av_name")
    fq, fa = first2_sql(nq), first2_sql(na)
    similar = (f"(lower({nq}) = lower({na}) OR ({fq} <> '' AND {fa} <> '' AND lower({fq}) = lower({fa})) "
               f"OR (length({nq}) > 3 AND strpos(lower({na}), lower({nq})) > 0) "
               f"OR (length({na}) > 3 AND strpos(lower({nq}), lower({na})) > 0))")
    return (f"CASE WHEN av_name IS NULL AND qb_name IS NOT NULL THEN 'LedgerOnly' "
            f"WHEN qb_name IS NULL THEN 'PayrollOnly' "
            f"WHEN lower(qb_name) = lower(av_name) THEN 'Exact' "
            f"WHEN mapped IS NOT NULL AND lower(mapped) = lower(av_name) THEN 'ExceptionRule' "
            f"WHEN {zero_out_sql('qb_total', 'av_total')} AND {similar} THEN 'AmountZeroOut' "
            f"WHEN lower({nq}) = lower({na}) THEN 'Normalized' "
            f"WHEN {fq} <> '' AND lower({fq}) = lower({fa}) THEN 'FirstWords' ELSE 'Fuzzy' END")


MATCH_NOTES_SQL = """CASE match_type WHEN 'ExceptionRule' THEN 'Matched via exception rule'
  WHEN 'AmountZeroOut' THEN 'Matched via amounts that zero out + similar names (likely same client)'
  WHEN 'Normalized' THEN 'Matched after name normalization' WHEN 'FirstWords' THEN 'Matched on first words'
  WHEN 'Fuzzy' THEN 'Fuzzy match (contains)' WHEN 'LedgerOnly' THEN 'Ledger only - no payroll match'
  WHEN 'PayrollOnly' THEN 'Payroll only - no ledger match' ELSE '' END"""


def summary_ctes() -> list[tuple[str, str]]:
    return client_ctes() + [
        ("dep1", "SELECT client_name, arg_min(payment_method, row_idx) AS payment_method FROM o_deposits "
                 "GROUP BY client_name"),
        ("lsite0", "SELECT name, memo, min(amount) AS o1 FROM o_ledger WHERE memo <> '' GROUP BY name, memo"),
        ("lsite", "SELECT s.name, s.memo, s.o1, min(o.item) AS o2 FROM lsite0 s JOIN o_ledger o ON o.name = s.name "
                  "AND o.memo = s.memo AND o.amount = s.o1 GROUP BY ALL"),
        ("lstat", "SELECT name AS ls_name, sum(amount) AS qb_balance, count(DISTINCT type) AS qb_invoice_count, "
                  "(SELECT string_agg(memo, ', ' ORDER BY o1, o2, memo) FROM lsite WHERE lsite.name = o_ledger.name) "
                  "AS job_sites FROM o_ledger GROUP BY name"),
        ("pstat", "SELECT bill_to_name AS ps_name, sum(item_bill) AS avi_balance, count(*) AS payroll_record_count, "
                  "string_agg(DISTINCT name, ', ' ORDER BY name) AS employees FROM o_payroll GROUP BY bill_to_name"),
        ("summary", f"""
SELECT coalesce(m.qb_name, m.unified_name) AS client_name,
  coalesce(CAST(ls.qb_balance AS DECIMAL(18,2)), 0.00::DECIMAL(18,2)) AS qb_balance,
  coalesce(m.av_name, '') AS avi_client_name,
  coalesce(CAST(ps.avi_balance AS DECIMAL(18,2)), 0.00::DECIMAL(18,2)) AS avi_balance,
  CAST(coalesce(CAST(ls.qb_balance AS DECIMAL(18,2)), 0) - coalesce(CAST(ps.avi_balance AS DECIMAL(18,2)), 0)
       AS DECIMAL(18,2)) AS variance,
  coalesce(dq.payment_method, da.payment_method, 'Research pymt method') AS payment_type,
  '' AS team, '' AS pr_rep, '' AS send_type, '' AS account_type, '' AS billing_notes,
  {MATCH_NOTES_SQL} AS notes, '' AS status,
  coalesce(ls.qb_invoice_count, 0) AS qb_invoice_count, coalesce(ps.payroll_record_count, 0) AS payroll_record_count,
  coalesce(ps.employees, '') AS employees, coalesce(ls.job_sites, '') AS job_sites, m.match_type, m.unified_name
FROM cmatch m
LEFT JOIN lstat ls ON coalesce(m.qb_name, '') <> '' AND m.qb_name = ls.ls_name
LEFT JOIN pstat ps ON coalesce(m.av_name, '') <> '' AND m.av_name = ps.ps_name
LEFT JOIN dep1 dq ON coalesce(m.qb_name, '') <> '' AND m.qb_name = dq.client_name
LEFT JOIN dep1 da ON coalesce(m.av_name, '') <> '' AND m.av_name = da.client_name"""),
    ]


def d3_ctes() -> list[tuple[str, str]]:
    """Reverse lookup (payroll -> ledger), brute force."""
    nq, na = norm_client_sql("qb_name"), norm_client_sql("av_name")
    sim = client_sim_sql("mapped", "qb_name")
    return client_ctes()[:4] + [
        ("pr", f"SELECT pc.av_name, rb.mapped, {na} AS av_norm FROM pc LEFT JOIN rb ON lower(pc.av_name) = rb.rule_key "
               "WHERE pc.av_name <> ''"),
        ("lr", f"SELECT qb_name, qb_o1, qb_o2, {nq} AS qb_norm FROM lc"),
        ("rcand", f"""
SELECT av_name, qb_name, 1 AS tier, 1.0 AS score FROM pr JOIN lr ON lower(mapped) = lower(qb_name)
UNION ALL SELECT av_name, qb_name, 2, {sim} FROM pr, lr WHERE mapped IS NOT NULL AND {sim} >= 0.75
UNION ALL SELECT av_name, qb_name, 3, 1.0 FROM pr JOIN lr ON lower(av_name) = lower(qb_name)
UNION ALL SELECT av_name, qb_name, 4, 1.0 FROM pr JOIN lr ON lower(av_norm) = lower(qb_norm)
UNION ALL SELECT av_name, qb_name, 5, 1.0 FROM pr JOIN lr ON {first2_sql('av_norm')} <> ''
  AND lower({first2_sql('av_norm')}) = lower({first2_sql('qb_norm')})
UNION ALL SELECT av_name, qb_name, 6, 1.0 FROM pr, lr
  WHERE strpos(lower(qb_norm), lower(av_norm)) > 0 OR strpos(lower(av_norm), lower(qb_norm)) > 0"""),
    ]


def client_sql() -> dict[str, str]:
    cc = client_ctes()
    sc = summary_ctes()
    nt, nc = norm_client_sql("target"), norm_client_sql("choice")
    sim = client_sim_sql("t_norm", "c_norm")
    fw = f"(CASE WHEN {first2_sql('t_norm')} <> '' AND {first2_sql('c_norm')} <> '' AND lower({first2_sql('t_norm')}) = lower({first2_sql('c_norm')}) THEN 0.85 ELSE 0.0 END)"  # noqa: E501
    ct = ("(CASE WHEN length(t_norm) >= 3 AND length(c_norm) >= 3 AND (strpos(lower(t_norm), lower(c_norm)) > 0 "
          "OR strpos(lower(c_norm), lower(t_norm)) > 0) THEN 0.75 ELSE 0.0 END)")
    ratio = lev_ratio_sql("t_norm", "c_norm")
    reason = (f"CASE WHEN lower(t_norm) = lower(c_norm) THEN 'Exact match' "
              f"WHEN {fw} > 0 THEN 'First words match (' || {pct_sql(fw)} || ')' "
              f"WHEN {ct} > 0 THEN 'Contains match (' || {pct_sql(ct)} || ')' "
              f"WHEN {ratio} > 0 THEN 'Similarity match (' || {pct_sql(ratio)} || ')' "
              f"ELSE 'No significant match' END")
    d6 = [("tg", f"SELECT DISTINCT qb_name AS target, {nt.replace('target', 'qb_name')} AS t_norm FROM lc"),
          ("ch", f"SELECT av_name AS choice, av_o1, {nc.replace('choice', 'av_name')} AS c_norm FROM pc"),
          ("sc", f"SELECT target, choice, av_o1, {sim} AS score, {reason} AS reason FROM tg, ch "
                 f"WHERE trim(target) <> '' AND {sim} >= 0.7"),
          ("b6", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, av_o1, choice) "
                 "AS rn FROM sc) x WHERE rn = 1")]
    return {
        "d1_bidirectional_rules": with_inputs(cc) + "SELECT rule_key, mapped FROM rb",
        "d2_best_payroll_client": with_inputs(cc) + "SELECT qb_name, av_name, tier, round(score, 6) AS score FROM cbest",
        "d3_best_ledger_client": with_inputs(d3_ctes()) + (
            "SELECT av_name, qb_name, tier FROM (SELECT c.*, row_number() OVER (PARTITION BY c.av_name ORDER BY "
            "c.tier, c.score DESC, lr.qb_o1, lr.qb_o2, c.qb_name) AS rn FROM rcand c JOIN lr USING (qb_name)) x "
            "WHERE rn = 1"),
        "d4_unified_matches": with_inputs(cc) + (
            "SELECT unified_name, qb_name, av_name, match_type, CAST(qb_total AS DECIMAL(18,2)) AS qb_total, "
            "CAST(av_total AS DECIMAL(18,2)) AS av_total FROM cmatch"),
        "d6_extract_best_client": with_inputs(cc + d6) + (
            "SELECT tg.target, b6.choice AS best_match, round(coalesce(b6.score, 0.0), 6) AS score, "
            "CASE WHEN trim(tg.target) = '' THEN 'Empty target' ELSE coalesce(b6.reason, "
            "'No match above 70% threshold') END AS reason FROM tg LEFT JOIN b6 USING (target)"),
        "b14_first_deposit_method": with_inputs(sc) + "SELECT client_name, payment_method FROM dep1",
        "e1_client_summary": with_inputs(sc) + "SELECT * FROM summary",
    }


# --- employees and variances (D9, D13, E2-E5) ---------------------------------------------

def employee_ctes() -> list[tuple[str, str]]:
    """All pairs inside each linked client scored; the greedy pass is a
    recursive CTE walking ledger employees in entry order."""
    ns = name_sim_sql("l_norm", "p_norm")
    avail = "list_filter(e.c, lambda z: NOT list_contains(f.used, lower(z)))[1]"
    return client_ctes() + [
        ("linked", "SELECT * FROM cmatch WHERE coalesce(qb_name, '') <> '' AND coalesce(av_name, '') <> ''"),
        ("le!", f"SELECT k.unified_name, l.item AS l_item, sum(l.amount) AS qa, min(l.amount) AS l_o1, "
               f"{norm_emp_sql('l.item')} AS l_norm FROM o_ledger l JOIN linked k ON l.name = k.qb_name "
               "GROUP BY k.unified_name, l.item"),
        ("pe!", f"SELECT k.unified_name, p.name AS p_name, sum(p.item_bill) AS pa, {norm_emp_sql('p.name')} AS p_norm "
               "FROM o_payroll p JOIN linked k ON p.bill_to_name = k.av_name GROUP BY k.unified_name, p.name"),
        ("epairs", f"SELECT le.unified_name, le.l_item, le.l_o1, le.qa, le.l_norm, pe.p_name, pe.pa, pe.p_norm, {ns} AS ns "
                   "FROM le JOIN pe ON le.unified_name = pe.unified_name WHERE trim(le.l_item) <> ''"),
        ("ecand!", f"SELECT * FROM (SELECT *, {composite_sql('ns', 'qa', 'pa')} AS comp FROM epairs) x "
                  "WHERE comp >= 0.6"),
        ("erank!", "SELECT *, row_number() OVER (PARTITION BY unified_name, l_item ORDER BY comp DESC, ns DESC, p_name) "
                  "AS rank FROM ecand"),
        ("lord!", "SELECT unified_name, l_item, row_number() OVER (PARTITION BY unified_name ORDER BY l_o1, l_item) AS o "
                 "FROM le"),
        ("clist!", "SELECT o.unified_name, o.o, o.l_item, coalesce(list(c.p_name ORDER BY c.rank) FILTER "
                  "(WHERE c.p_name IS NOT NULL), CAST([] AS VARCHAR[])) AS c FROM lord o LEFT JOIN erank c "
                  "ON c.unified_name = o.unified_name AND c.l_item = o.l_item GROUP BY o.unified_name, o.o, o.l_item"),
        ("fold", f"""
SELECT DISTINCT unified_name, CAST(0 AS BIGINT) AS o, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS m,
  CAST(NULL AS VARCHAR) AS l_item FROM lord
UNION ALL
SELECT f.unified_name, e.o, CASE WHEN {avail} IS NULL THEN f.used ELSE list_append(f.used, lower({avail})) END,
  {avail}, e.l_item
FROM fold f JOIN clist e ON e.unified_name = f.unified_name AND e.o = f.o + 1"""),
        ("assigned!", "SELECT unified_name, l_item, m AS p_name FROM fold WHERE o > 0 AND m IS NOT NULL"),
        ("eled", f"""
SELECT le.unified_name, le.l_item AS employee_name, le.l_item AS ledger_name, a.p_name AS payroll_name,
  le.qa AS ledger_amount, coalesce(pe.pa, 0) AS payroll_amount,
  CASE WHEN a.p_name IS NULL THEN 'LedgerOnly' WHEN lower(le.l_item) = lower(a.p_name) THEN 'Exact'
       WHEN lower({norm_emp_sql('le.l_item')}) = lower({norm_emp_sql('a.p_name')}) THEN 'Normalized' ELSE 'Fuzzy' END
    AS emp_match_type,
  0 AS w_side, le.l_o1 AS w_amt, le.l_item AS w_str
FROM le LEFT JOIN assigned a ON a.unified_name = le.unified_name AND a.l_item = le.l_item
LEFT JOIN pe ON pe.unified_name = a.unified_name AND pe.p_name = a.p_name"""),
        ("erest", """
SELECT pe.unified_name, pe.p_name, CAST(NULL AS VARCHAR), pe.p_name, 0, pe.pa, 'PayrollOnly', 1,
  CAST(NULL AS DECIMAL(18,2)), pe.p_name
FROM pe WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.unified_name = pe.unified_name
                                                     AND lower(a.p_name) = lower(pe.p_name))"""),
        ("emp!", "SELECT unified_name, employee_name, ledger_name, payroll_name, ledger_amount, payroll_amount, "
                "emp_match_type FROM (SELECT *, row_number() OVER (PARTITION BY unified_name, lower(employee_name) "
                "ORDER BY w_side DESC, w_amt DESC NULLS LAST, w_str DESC) AS rn FROM (SELECT * FROM eled UNION ALL "
                "SELECT * FROM erest) u) x WHERE rn = 1"),
        ("v2", f"""
SELECT unified_name AS client_name, employee_name, 'Multiple' AS job_site, ledger_amount, payroll_amount,
  CASE emp_match_type WHEN 'LedgerOnly' THEN 'Ledger Only Employee' WHEN 'PayrollOnly' THEN 'Payroll Only Employee'
       ELSE 'Employee Amount Variance' END AS variance_type,
  CASE emp_match_type WHEN 'LedgerOnly' THEN 'Employee exists only in the ledger for client ' || unified_name
       WHEN 'PayrollOnly' THEN 'Employee exists only in payroll for client ' || unified_name
       ELSE 'Employee amounts differ: ledger $' || {n2_sql('ledger_amount')} || ' vs payroll $' ||
            {n2_sql('payroll_amount')} || ' (Match: ' || emp_match_type || ')' END AS notes
FROM emp WHERE abs(ledger_amount - payroll_amount) > 0.01
  AND NOT (emp_match_type NOT IN ('LedgerOnly', 'PayrollOnly') AND {zero_out_sql('ledger_amount', 'payroll_amount')})"""),
        ("eagg", f"""
SELECT unified_name,
  sum(CASE WHEN coalesce(ledger_name, '') <> '' AND coalesce(payroll_name, '') <> ''
           AND NOT {zero_out_sql('ledger_amount', 'payroll_amount')} THEN ledger_amount - payroll_amount ELSE 0 END)
    AS matched_var,
  sum(CASE WHEN NOT (coalesce(ledger_name, '') <> '' AND coalesce(payroll_name, '') <> '')
           THEN ledger_amount - payroll_amount ELSE 0 END) AS unmatched_var
FROM emp GROUP BY unified_name"""),
        ("v3", f"""
SELECT unified_name AS client_name, 'Client Total' AS employee_name, 'All' AS job_site, qb_total AS ledger_amount,
  av_total AS payroll_amount, 'Client Level Variance' AS variance_type,
  'Client total variance: ' || {currency_sql('cv')} || ' (Match: ' || match_type || ') - Unexplained: ' ||
  {currency_sql('unexplained')} AS notes
FROM (SELECT k.*, k.qb_total - k.av_total AS cv,
        (k.qb_total - k.av_total) - (coalesce(a.matched_var, 0) + coalesce(a.unmatched_var, 0)) AS unexplained
      FROM linked k LEFT JOIN eagg a USING (unified_name)) x
WHERE abs(cv) > 0.01 AND abs(unexplained) > 0.01"""),
        ("v4", """
SELECT CASE WHEN match_type = 'LedgerOnly' THEN qb_name ELSE av_name END AS client_name, 'Total' AS employee_name,
  'All' AS job_site, CASE WHEN match_type = 'LedgerOnly' THEN qb_total ELSE 0 END AS ledger_amount,
  CASE WHEN match_type = 'PayrollOnly' THEN av_total ELSE 0 END AS payroll_amount,
  CASE WHEN match_type = 'LedgerOnly' THEN 'Ledger Only Client' ELSE 'Payroll Only Client' END AS variance_type,
  CASE WHEN match_type = 'LedgerOnly' THEN 'Client exists only in the ledger' ELSE 'Client exists only in payroll' END
    AS notes
FROM cmatch WHERE match_type IN ('LedgerOnly', 'PayrollOnly')"""),
        ("variances", """
SELECT client_name, employee_name, job_site, CAST(ledger_amount AS DECIMAL(18,2)) AS ledger_amount,
  CAST(payroll_amount AS DECIMAL(18,2)) AS payroll_amount,
  CAST(ledger_amount - payroll_amount AS DECIMAL(18,2)) AS variance, variance_type, notes
FROM (SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4) u"""),
    ]


def employee_sql() -> dict[str, str]:
    ec = employee_ctes()
    w = lambda q: with_inputs(ec, recursive=True) + q
    return {
        "d9_best_context_match": w("SELECT unified_name, l_item, p_name, round(comp, 6) AS composite, "
                                   "round(ns, 6) AS name_sim FROM erank WHERE rank = 1"),
        "d13_greedy_assignment": w("SELECT unified_name, l_item, p_name FROM assigned"),
        "e2_employee_matches": w("SELECT unified_name, employee_name, ledger_name, payroll_name, "
                                 "CAST(ledger_amount AS DECIMAL(18,2)) AS ledger_amount, "
                                 "CAST(payroll_amount AS DECIMAL(18,2)) AS payroll_amount, emp_match_type FROM emp"),
        "e5_variance_analysis": w("SELECT * FROM variances"),
    }


# --- name-only employee matching (D7, D8, D10) -----------------------------------------------

def name_only_sql() -> dict[str, str]:
    """Every pair of a linked client scored and labelled, the best one by a window."""
    wt, wc = words_sql("lower(l_norm)"), words_sql("lower(p_norm)")
    valid = f"len({wt}) >= 2 AND len({wc}) >= 2"
    tier = (f"CASE WHEN lower(l_item) = lower(p_name) THEN 1 WHEN lower(l_norm) = lower(p_norm) THEN 2 "
            f"WHEN {valid} AND {comp_similar_sql('l_norm', 'p_norm')} THEN 3 WHEN {valid} AND {wt}[1:2] = {wc}[1:2] THEN 4 "
            "WHEN ns >= 0.8 THEN 5 WHEN ns >= 0.6 THEN 6 END")
    extra = [
        ("ntier!", f"SELECT unified_name, l_item, l_o1, l_norm, qa, p_name, p_norm, pa, ns, {tier} AS tier FROM epairs"),
        ("nbest!", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unified_name, l_item ORDER BY tier, "
                   "CASE WHEN tier >= 5 THEN -ns ELSE 0 END, p_name) AS rn FROM ntier WHERE tier IS NOT NULL) x WHERE rn = 1"),
        ("nextract!", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unified_name, l_item ORDER BY ns DESC, p_name) AS rn "
                      "FROM ntier WHERE ns >= 0.8) x WHERE rn = 1"),
        ("ntable", f"""
SELECT le.unified_name, le.l_item AS employee_name, le.l_item AS ledger_name, b.p_name AS payroll_name, le.qa AS ledger_amount,
  coalesce(b.pa, 0) AS payroll_amount, CASE WHEN b.p_name IS NULL THEN 'LedgerOnly' WHEN lower(le.l_item) = lower(b.p_name) THEN 'Exact'
    WHEN lower(b.l_norm) = lower(b.p_norm) THEN 'Normalized'
    WHEN len({words_sql("b.l_norm")}) >= 2 AND len({words_sql("b.p_norm")}) >= 2 AND {comp_similar_sql("b.l_norm", "b.p_norm")} THEN 'NameComponents'
    ELSE 'Fuzzy' END AS emp_match_type, 0 AS side, le.l_o1 AS o1, le.l_item AS o2
FROM le LEFT JOIN nbest b ON b.unified_name = le.unified_name AND b.l_item = le.l_item
UNION ALL
SELECT pe.unified_name, pe.p_name, NULL, pe.p_name, 0, pe.pa, 'PayrollOnly', 1, NULL, pe.p_name FROM pe
WHERE NOT EXISTS (SELECT 1 FROM nbest b WHERE b.unified_name = pe.unified_name AND lower(b.p_name) = lower(pe.p_name))"""),
    ]
    w = lambda q: with_inputs(employee_ctes() + extra, recursive=True) + q
    return {
        "d7_best_employee": w("SELECT unified_name, l_item, p_name AS best_match, tier, round(ns, 6) AS name_sim FROM nbest"),
        "d8_extract_best_employee": w(
            "SELECT le.unified_name, le.l_item, x.p_name AS best_match, round(coalesce(x.ns, 0.0), 6) AS score, "
            "CASE WHEN trim(le.l_item) = '' THEN 'Empty target' WHEN x.p_name IS NULL THEN 'No match above 80% threshold' "
            f"ELSE {emp_reason_sql('x.l_norm', 'x.p_norm')} END AS reason "
            "FROM le LEFT JOIN nextract x ON x.unified_name = le.unified_name AND x.l_item = le.l_item"),
        "d10_employee_match_table": w(
            "SELECT unified_name, employee_name, ledger_name, payroll_name, CAST(ledger_amount AS DECIMAL(18,2)) AS ledger_amount, "
            "CAST(payroll_amount AS DECIMAL(18,2)) AS payroll_amount, emp_match_type FROM (SELECT *, row_number() OVER (PARTITION BY "
            "unified_name, lower(employee_name) ORDER BY side DESC, o1 DESC NULLS LAST, o2 DESC) AS rn FROM ntable) x WHERE rn = 1"),
    }


# --- remaining operators -------------------------------------------------------------------

def _dedupe(ctes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    seen, out = set(), []
    for n, q in ctes:
        if n.rstrip("!") not in seen:
            seen.add(n.rstrip("!"))
            out.append((n, q))
    return out


def comp_similar_sql(a: str, b: str) -> str:
    wa, wb = words_sql(a), words_sql(b)
    na, nb = f"len({wa})", f"len({wb})"
    f1, f2 = f"coalesce({wa}[1], '')", f"coalesce({wb}[1], '')"
    l1 = f"(CASE WHEN {na} > 1 THEN {wa}[{na}] ELSE '' END)"
    l2 = f"(CASE WHEN {nb} > 1 THEN {wb}[{nb}] ELSE '' END)"
    la, lb = f"list_transform({wa}, lambda x: lower(x))", f"list_transform({wb}, lambda x: lower(x))"
    prefix = f"(CASE WHEN {na} < {nb} THEN {lb}[1:{na}] = {la} ELSE {la}[1:{nb}] = {lb} END)"
    fok = f"(lower({f1}) = lower({f2}) OR {str_sim_sql(f1, f2)} >= 0.8)"
    lok = f"(lower({l1}) = lower({l2}) OR {str_sim_sql(l1, l2)} >= 0.8)"
    return (f"(CASE WHEN {f1} = '' OR {f2} = '' THEN false WHEN NOT {fok} THEN false "
            f"WHEN {na} <> {nb} THEN {prefix} WHEN {l1} <> '' AND {l2} <> '' THEN {lok} "
            f"ELSE {str_sim_sql(a, b)} >= 0.8 END)")


def emp_reason_sql(a: str, b: str) -> str:
    r, p, so, se, c = str_sim_sql(a, b), partial_sql(a, b), sort_sql(a, b), set_sql(a, b), comp_sql(a, b)
    best = f"greatest({r}, {p}, {so}, {se}, {c})"
    label = (f"CASE WHEN {r} = {best} THEN 'Basic similarity' WHEN {p} = {best} THEN 'Partial match' "
             f"WHEN {so} = {best} THEN 'Word order similarity' WHEN {se} = {best} THEN 'Word set similarity' "
             f"ELSE 'Name component match' END")
    return f"CASE WHEN lower({a}) = lower({b}) THEN 'Exact match' ELSE {label} || ' (' || {pct_sql(best)} || ')' END"


def misc_sql() -> dict[str, str]:
    cc, sc, ec = client_ctes(), summary_ctes(), employee_ctes()
    allc = _dedupe(sc + ec)
    wr = lambda q: with_inputs(allc, recursive=True) + q
    tree = ("kids", "SELECT name AS g, item AS k, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, count(*) AS cnt "
                    "FROM o_ledger GROUP BY name, item")
    tree_rows = ("tree", "SELECT 'group' AS level, g AS group_name, CAST(NULL AS VARCHAR) AS key, "
                         "CAST(sum(amount) AS DECIMAL(18,2)) AS amount, sum(cnt)::BIGINT AS quantity, "
                         "sum(cnt)::BIGINT AS cnt, count(*) AS n_children FROM kids GROUP BY g UNION ALL "
                         "SELECT 'item', g, k, amount, cnt, cnt, CAST(NULL AS BIGINT) FROM kids")
    sim = client_sim_sql("a", "b")
    fwa, fwb = first2_sql("a"), first2_sql("b")
    fw = f"(CASE WHEN {fwa} <> '' AND {fwb} <> '' AND lower({fwa}) = lower({fwb}) THEN 0.85 ELSE 0.0 END)"
    ct = ("(CASE WHEN length(a) >= 3 AND length(b) >= 3 AND (strpos(lower(a), lower(b)) > 0 "
          "OR strpos(lower(b), lower(a)) > 0) THEN 0.75 ELSE 0.0 END)")
    ratio = lev_ratio_sql("a", "b")
    reason = (f"CASE WHEN lower(a) = lower(b) THEN 'Exact match' "
              f"WHEN {fw} > 0 THEN 'First words match (' || {pct_sql(fw)} || ')' "
              f"WHEN {ct} > 0 THEN 'Contains match (' || {pct_sql(ct)} || ')' "
              f"WHEN {ratio} > 0 THEN 'Similarity match (' || {pct_sql(ratio)} || ')' "
              f"ELSE 'No significant match' END")
    summ_cols = ("client_name, qb_balance, avi_client_name, avi_balance, variance, payment_type, team, pr_rep, "
                 "send_type, account_type, billing_notes, notes, status, qb_invoice_count, payroll_record_count, "
                 "match_type, unified_name")
    sev = "CASE WHEN abs(variance) > 100 THEN 'major' WHEN abs(variance) > 10 THEN 'minor' ELSE 'none' END"
    sign = "CASE WHEN variance > 0 THEN 'positive' WHEN variance < 0 THEN 'negative' ELSE 'zero' END"
    badge = "CASE WHEN payment_type = 'Check' THEN 'check' WHEN payment_type = 'ACH' THEN 'ach' ELSE 'other' END"
    pat = "(?i)(?:/(?:dp|gp/product|gp/aw/d|gp/offer-listing)/|[?&](?:ASIN|asin)=)([A-Z0-9]{10})"
    pid = (f"CASE WHEN trim(coalesce(product_link, '')) = '' THEN CAST(NULL AS VARCHAR) "
           f"ELSE upper(nullif(regexp_extract(trim(product_link), '{pat}', 1), '')) END")
    ol = [("olp", f"SELECT *, {pid} AS product_id FROM f_order_lines"),
          ("ptot", "SELECT order_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity, min(line_no) AS first_line "
                   "FROM olp WHERE trim(coalesce(product_link, '')) <> '' AND quantity > 0 AND product_id IS NOT NULL "
                   "AND quantity >= 1 GROUP BY order_id, product_id"),
          ("slots", "SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY first_line, product_id) AS i, "
                    "product_id, quantity FROM ptot")]
    tn, pn = norm_emp_sql("target"), norm_emp_sql("name")
    trace = [
        ("lh", "SELECT * FROM o_ledger WHERE strpos(lower(item), 'okafor') > 0"),
        ("ph", "SELECT * FROM o_payroll WHERE strpos(lower(name), 'okafor') > 0"),
        ("tm", "SELECT m.*, coalesce(m.qb_name, '') <> '' AND coalesce(m.av_name, '') <> '' AS is_linked, "
               "coalesce(m.qb_name IN (SELECT name FROM lh), false) AS ledger_has, "
               "coalesce(m.av_name IN (SELECT bill_to_name FROM ph), false) AS payroll_has FROM cmatch m"),
        ("tm2", "SELECT * FROM tm WHERE ledger_has OR payroll_has"),
        ("tf0", "SELECT k.unified_name, k.av_name, k.qb_name, min(lh.amount) AS a1 FROM lh JOIN tm2 k "
                "ON lh.name = k.qb_name WHERE k.is_linked AND k.ledger_has GROUP BY ALL"),
        ("tf", "SELECT f.unified_name, f.av_name, f.qb_name, min(lh.item) AS target FROM tf0 f JOIN lh "
               "ON lh.name = f.qb_name AND lh.amount = f.a1 GROUP BY ALL"),
        ("tt", f"SELECT f.*, {tn} AS t_norm, (SELECT sum(amount) FROM o_ledger o WHERE o.name = f.qb_name "
               "AND o.item = f.target) AS target_amount FROM tf f"),
        ("tpe", f"SELECT bill_to_name, name, sum(item_bill) AS amount, {pn} AS p_norm FROM o_payroll GROUP BY ALL"),
        ("tc0", f"SELECT t.unified_name, t.target, t.target_amount, p.name, p.amount, "
                f"{name_sim_sql('t.t_norm', 'p.p_norm')} AS ns FROM tt t JOIN tpe p ON p.bill_to_name = t.av_name"),
        ("tc", f"SELECT *, {composite_sql('ns', 'target_amount', 'amount')} AS score FROM tc0"),
        ("tc2", "SELECT *, CASE WHEN score >= 0.6 THEN row_number() OVER (PARTITION BY unified_name ORDER BY "
                "score DESC, ns DESC, name) END AS rk FROM tc"),
    ]
    trace_sql = """
SELECT 'ledger_hit' AS section, name AS client_name, 'ledger' AS side, item AS employee,
  CAST(amount AS DECIMAL(18,2)) AS amount, NULL::VARCHAR AS ledger_name, NULL::VARCHAR AS payroll_name,
  NULL::BOOLEAN AS is_linked, NULL::BOOLEAN AS ledger_has, NULL::BOOLEAN AS payroll_has, NULL::VARCHAR AS target,
  NULL::DECIMAL(18,2) AS target_amount, NULL::DOUBLE AS score, NULL::BOOLEAN AS is_match,
  NULL::DECIMAL(18,2) AS amount_diff FROM lh
UNION ALL SELECT 'payroll_hit', bill_to_name, 'payroll', name, item_bill, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL FROM ph
UNION ALL SELECT 'client_match', unified_name, NULL, NULL, NULL, qb_name, av_name, is_linked, ledger_has, payroll_has,
  NULL, NULL, NULL, NULL, NULL FROM tm2
UNION ALL SELECT 'candidate', unified_name, 'payroll', name, amount, NULL, NULL, NULL, NULL, NULL, target,
  target_amount, round(score, 6), coalesce(rk = 1, false),
  CASE WHEN rk = 1 THEN abs(target_amount - amount) END FROM tc2"""
    c19 = f"""
SELECT unified_name, l_item, p_name, round({str_sim_sql('l_norm', 'p_norm')}, 6) AS ratio,
  round({partial_sql('l_norm', 'p_norm')}, 6) AS partial, round({sort_sql('l_norm', 'p_norm')}, 6) AS token_sort,
  round({set_sql('l_norm', 'p_norm')}, 6) AS token_set, round({comp_sql('l_norm', 'p_norm')}, 6) AS component,
  round(ns, 6) AS name_sim, {emp_reason_sql('l_norm', 'p_norm')} AS reason,
  round({amount_sim_sql('qa', 'pa')}, 6) AS amount_sim, round(comp, 6) AS composite,
  CASE WHEN lower(l_item) = lower(p_name) THEN 'Exact' WHEN lower(l_norm) = lower(p_norm) THEN 'Normalized'
       WHEN len({words_sql('l_norm')}) >= 2 AND len({words_sql('p_norm')}) >= 2
            AND {comp_similar_sql('l_norm', 'p_norm')} THEN 'NameComponents' ELSE 'Fuzzy' END AS name_type
FROM ecand"""
    ann = ("ann", "SELECT client_name AS a_client, max(billing_notes) AS a_billing, max(notes) AS a_notes, "
                  "max(status) AS a_status FROM o_annotations GROUP BY client_name")
    money = ("CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({x}) AS DOUBLE))")
    return {
        "a12_payroll_week": with_inputs() + (
            "SELECT name, bill_to_name, week_worked, CAST(week_worked - CAST(dayofweek(week_worked) AS INTEGER) "
            "AS DATE) AS week_start FROM o_payroll"),
        "a13_payroll_zero_rows": with_inputs() + "SELECT * FROM o_payroll WHERE item_bill = 0 OR item_pay = 0",
        "a13_payroll_nonzero_rows": with_inputs() + "SELECT * FROM o_payroll WHERE item_bill <> 0 AND item_pay <> 0",
        "a12_processing_week_rows": with_inputs() + (
            "SELECT * FROM o_payroll WHERE week_worked >= DATE '1996-03-10' AND week_worked < DATE '1996-03-17'"),
        "a11_payroll_rollup": with_inputs() + (
            "SELECT name, bill_to_name, item_bill, item_pay, week_worked FROM (SELECT trim(first_name) || ' ' || trim(last_name) AS name, "
            "CASE WHEN starts_with(lower(bill_to_name), 'dart entities') THEN 'Dart Entities' ELSE trim(bill_to_name) END AS bill_to_name, "
            "TRY_CAST(item_bill AS DECIMAL(18,2)) AS item_bill, TRY_CAST(item_pay AS DECIMAL(18,2)) AS item_pay, "
            "TRY_CAST(week_worked AS DATE) AS week_worked FROM f_payroll_text) x "
            "WHERE item_bill IS NOT NULL AND item_pay IS NOT NULL AND week_worked IS NOT NULL"),
        "a5_ledger_rejects": with_inputs() + (
            "SELECT ok, ln, name, item, type, amount_text FROM f_ledger WHERE trim(coalesce(type, '')) <> '' "
            "AND TRY_CAST(trim(amount_text) AS DECIMAL(18,2)) IS NULL"),
        "a5_payroll_rejects": with_inputs() + (
            "SELECT * FROM f_payroll_text WHERE TRY_CAST(item_bill AS DECIMAL(18,2)) IS NULL "
            "OR TRY_CAST(item_pay AS DECIMAL(18,2)) IS NULL OR TRY_CAST(week_worked AS DATE) IS NULL"),
        "a5_deposit_rejects": with_inputs() + (
            "SELECT * FROM f_deposits WHERE trim(coalesce(type, '')) <> '' AND (TRY_CAST(trim(amount_text) AS DECIMAL(18,2)) IS NULL "
            "OR deposit_date IS NULL)"),
        "b16_rep_tree_kpis": with_inputs() + (
            "SELECT count(DISTINCT rep) AS n_groups, count(DISTINCT struct_pack(a := rep, b := name)) AS n_children "
            "FROM o_ledger WHERE rep <> ''"),
        "b16_payroll_tree_kpis": with_inputs() + (
            "SELECT count(DISTINCT bill_to_name) AS n_groups, count(DISTINCT struct_pack(a := bill_to_name, b := name)) AS n_children "
            "FROM o_payroll"),
        "k5_request_violations": with_inputs() + (
            "SELECT order_id, line_no, rule FROM (SELECT order_id, line_no, unnest(["
            "CASE WHEN trim(coalesce(email, '')) = '' THEN 'email required' END, "
            "CASE WHEN trim(coalesce(name, '')) = '' THEN 'name required' END, "
            "CASE WHEN trim(coalesce(department, '')) = '' THEN 'department required' END, "
            "CASE WHEN trim(coalesce(product_link, '')) = '' THEN 'product_link required' END, "
            "CASE WHEN trim(coalesce(ship_to, '')) = '' THEN 'ship_to required' END, "
            "CASE WHEN quantity < 1 OR quantity > 1000 THEN 'quantity out of range' END]) AS rule FROM f_requests) x "
            "WHERE rule IS NOT NULL"),
        "b9_expanded_view": with_inputs([tree, tree_rows]) + (
            "SELECT * FROM tree WHERE level = 'group' OR group_name IN "
            "('Harbor Mechanical', 'Summit Electric', 'Keystone Roofing')"),
        "b16_tree_kpis": with_inputs([tree, tree_rows]) + (
            "SELECT CAST(sum(CASE WHEN level = 'group' THEN 1 ELSE 0 END) AS BIGINT) AS n_groups, "
            "CAST(sum(CASE WHEN level = 'item' THEN 1 ELSE 0 END) AS BIGINT) AS n_children FROM tree"),
        "b16_flat_kpis": with_inputs() + (
            "SELECT count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount FROM (SELECT item, memo, "
            "CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM o_ledger WHERE memo <> '' GROUP BY item, memo) x"),
        "b15_dashboard_kpis": wr(
            "SELECT (SELECT count(*) FROM o_ledger) AS ledger_records, (SELECT count(*) FROM o_payroll) AS "
            "payroll_records, (SELECT count(*) FROM summary) AS clients, (SELECT count(*) FROM variances) AS variances"),
        "c7_client_scores": with_inputs(cc) + (
            f"SELECT a, b, round({ratio}, 6) AS ratio, {fw} AS first_words, {ct} AS contains, round({sim}, 6) AS "
            f"similarity, {reason} AS reason FROM (SELECT DISTINCT qb_norm AS a FROM lcx) x, "
            f"(SELECT DISTINCT av_norm AS b FROM pcx) y WHERE a <> '' AND b <> '' AND {sim} >= 0.5"),
        "c19_employee_scores": wr(c19),
        "f1_summary_filter": with_inputs(sc) + (
            f"SELECT {summ_cols} FROM summary WHERE strpos(lower(client_name), 'an') > 0 "
            "AND abs(variance) >= abs(-1000)"),
        "f2_variance_filter": wr(
            "SELECT * FROM variances WHERE strpos(lower(variance_type), 'employee') > 0 AND ledger_amount >= 0 "
            "AND abs(variance) >= 50"),
        "f3_variance_display": wr(
            f"SELECT *, {sev} AS severity, {sign} AS sign, {money.format(x='ledger_amount')} AS ledger_amount_text, "
            f"{money.format(x='payroll_amount')} AS payroll_amount_text, {money.format(x='variance')} AS variance_text "
            "FROM variances"),
        "f7_annotated_summary": with_inputs(sc + [ann]) + (
            f"SELECT * EXCLUDE (billing_notes, notes, status, a_client, a_billing, a_notes, a_status), "
            "coalesce(a_billing, billing_notes) AS billing_notes, coalesce(a_notes, notes) AS notes, "
            "CASE WHEN a_status IN ('Complete', 'Pending', 'Review', 'Issue') THEN a_status ELSE status END AS status, "
            f"{sev} AS severity, {sign} AS sign, {badge} AS payment_badge, {money.format(x='variance')} AS variance_text "
            f"FROM (SELECT {summ_cols} FROM summary) s LEFT JOIN ann ON s.client_name = ann.a_client"),
        "g5_summary_sorted": with_inputs(sc) + f"SELECT {summ_cols} FROM summary",
        "g6_variances_sorted": wr("SELECT * FROM variances"),
        "e7_match_trace": with_inputs(cc + trace) + trace_sql,
        "k1_product_ids": with_inputs(ol) + "SELECT order_id, line_no, product_id FROM olp",
        "k2_product_totals": with_inputs(ol) + "SELECT * FROM ptot",
        "k3_cart_links": with_inputs(ol) + (
            "SELECT o.order_id, coalesce('https://www.amazon.com/gp/aws/cart/add.html?' || c.items || "
            "'&AssociateTag=yourtag-20', '') AS cart_link FROM (SELECT DISTINCT order_id FROM f_order_lines) o "
            "LEFT JOIN (SELECT order_id, string_agg('ASIN.' || i || '=' || product_id || '&Quantity.' || i || '=' || "
            "quantity, '&' ORDER BY i) AS items FROM slots GROUP BY order_id) c USING (order_id)"),
        "k4_line_texts": with_inputs() + (
            "SELECT order_id, line_no, CAST(line_no AS VARCHAR) || '. ' || coalesce(product_link, '') || ' | Qty: ' || "
            "CAST(quantity AS VARCHAR) || ' | Ship To: ' || coalesce(ship_to, '') || ' | Date Needed: ' || "
            "coalesce(strftime(date_needed, '%m/%d/%Y'), 'N/A') AS line_text FROM f_order_lines "
            "WHERE trim(coalesce(product_link, '')) <> ''"),
        "k5_constraint_violations": with_inputs() + (
            "SELECT order_id, line_no, rule FROM (SELECT order_id, line_no, unnest([CASE WHEN trim(coalesce("
            "product_link, '')) = '' THEN 'product_link required' END, CASE WHEN trim(coalesce(ship_to, '')) = '' "
            "THEN 'ship_to required' END, CASE WHEN quantity < 1 OR quantity > 1000 THEN 'quantity out of range' "
            "END]) AS rule FROM f_order_lines) x WHERE rule IS NOT NULL"),
    }


def explicit_sql() -> dict[str, str]:
    cc, sc, ec = client_ctes(), summary_ctes(), employee_ctes()
    wr = lambda q: with_inputs(_dedupe(sc + ec), recursive=True) + q
    return {
        "a8_a9_client_and_site": with_inputs() + (
            "SELECT raw_name, trim(regexp_replace(raw_name, ':.*|--.*', '', 'g')) AS client, "
            "trim(regexp_replace(raw_name, '.*?:|.*?--', '', 'g')) AS site FROM "
            "(SELECT DISTINCT trim(coalesce(name, '')) AS raw_name FROM f_ledger) x"),
        "b10_client_totals": with_inputs() + (
            "SELECT name AS client_name, CAST(sum(amount) AS DECIMAL(18,2)) AS total, 'ledger' AS side FROM o_ledger "
            "GROUP BY name UNION ALL SELECT bill_to_name, CAST(sum(item_bill) AS DECIMAL(18,2)), 'payroll' "
            "FROM o_payroll GROUP BY bill_to_name"),
        "b11_employee_totals": wr(
            "SELECT unified_name, 'ledger' AS side, l_item AS employee, CAST(qa AS DECIMAL(18,2)) AS amount FROM le "
            "UNION ALL SELECT unified_name, 'payroll', p_name, CAST(pa AS DECIMAL(18,2)) FROM pe"),
        "b12_b13_client_stats": with_inputs(sc) + (
            "SELECT ls_name AS client_name, 'ledger' AS side, qb_invoice_count AS n, coalesce(job_sites, '') AS "
            "distinct_values FROM lstat UNION ALL SELECT ps_name, 'payroll', payroll_record_count, employees FROM pstat"),
        "d5_match_type_counts": with_inputs(cc) + "SELECT match_type, count(*) AS clients FROM cmatch GROUP BY match_type",
        "d14_payment_types": with_inputs(sc) + "SELECT client_name, avi_client_name, payment_type, notes FROM summary",
        "e3_client_level_variances": wr("SELECT * FROM variances WHERE variance_type = 'Client Level Variance'"),
        "e4_one_sided_clients": wr(
            "SELECT * FROM variances WHERE variance_type IN ('Ledger Only Client', 'Payroll Only Client')"),
    }
