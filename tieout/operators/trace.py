"""Match trace for a search text (E7), as a long-form DataFrame.

Sections: ``ledger_hit`` / ``payroll_hit`` (rows whose employee contains the
text, case-insensitively), ``client_match`` (linked clients where either
side has such an employee, with flags) and ``candidate`` (for a linked
client whose ledger side has a hit: its first hit in entry order scored
against every payroll employee of the linked client, the best composite
>= 0.6 flagged, with the amount difference). One target per client, so the
candidate section is linear in the client's payroll employees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import composite_score, normalize_employee
from ..session import cut_lineage
from .clients import ClientMatch, with_flags
from .employees import CONTEXT_THRESHOLD, with_name_scores

COLUMNS = ["section", "client_name", "side", "employee", "amount", "ledger_name", "payroll_name", "is_linked",
           "ledger_has", "payroll_has", "target", "target_amount", "score", "is_match", "amount_diff"]


def _pad(df: DataFrame) -> DataFrame:
    types = {"amount": "decimal(18,2)", "target_amount": "decimal(18,2)", "amount_diff": "decimal(18,2)",
             "score": "double", "is_match": "boolean", "is_linked": "boolean", "ledger_has": "boolean",
             "payroll_has": "boolean"}
    cols = [F.col(c).cast(types.get(c, "string")).alias(c) if c in df.columns
            else F.lit(None).cast(types.get(c, "string")).alias(c) for c in COLUMNS]
    return df.select(*cols)


def match_trace(cm: ClientMatch, ledger: DataFrame, payroll: DataFrame, search: str) -> DataFrame:
    s = search.lower()
    lh = ledger.filter(F.instr(F.lower("item"), F.lit(s)) > 0)
    ph = payroll.filter(F.instr(F.lower("name"), F.lit(s)) > 0)
    sec1 = _pad(lh.select(F.lit("ledger_hit").alias("section"), F.col("name").alias("client_name"),
                          F.lit("ledger").alias("side"), F.col("item").alias("employee"), "amount"))
    sec2 = _pad(ph.select(F.lit("payroll_hit").alias("section"), F.col("bill_to_name").alias("client_name"),
                          F.lit("payroll").alias("side"), F.col("name").alias("employee"),
                          F.col("item_bill").alias("amount")))
    lhc = lh.select(F.col("name").alias("lh_client")).distinct()
    phc = ph.select(F.col("bill_to_name").alias("ph_client")).distinct()
    m = (with_flags(cm.matches)
         .join(lhc, F.col("qb_name") == F.col("lh_client"), "left")
         .join(phc, F.col("av_name") == F.col("ph_client"), "left")
         .withColumn("ledger_has", F.col("lh_client").isNotNull())
         .withColumn("payroll_has", F.col("ph_client").isNotNull())
         .filter("ledger_has OR payroll_has"))
    sec3 = _pad(m.select(F.lit("client_match").alias("section"), F.col("unified_name").alias("client_name"),
                         F.col("qb_name").alias("ledger_name"), F.col("av_name").alias("payroll_name"),
                         "is_linked", "ledger_has", "payroll_has"))
    # first hit per linked client in entry order (amount, item), with that employee's client total
    tgt_clients = m.filter("is_linked AND ledger_has").select("unified_name", "qb_name", "av_name")
    # aggregate before joining: hits per client, totals per (client, employee)
    hit1 = lh.groupBy("name").agg(F.min(F.struct("amount", "item")).alias("f"))
    first = (hit1.join(tgt_clients, hit1.name == tgt_clients.qb_name)
             .select("unified_name", "av_name", "qb_name", F.col("f.item").alias("target")))
    emp_tot = ledger.groupBy("name", "item").agg(F.sum("amount").alias("target_amount"))
    tot = (emp_tot.join(first.select("qb_name", "target"),
                        (emp_tot.name == first.qb_name) & (emp_tot.item == first.target))
           .select("qb_name", "target", "target_amount"))
    tgt = first.join(tot, ["qb_name", "target"])
    pe = payroll.groupBy("bill_to_name", "name").agg(F.sum("item_bill").alias("amount"))
    c = (tgt.join(pe, tgt.av_name == pe.bill_to_name)
         .withColumn("tn", normalize_employee(F.col("target"))).withColumn("cn", normalize_employee(F.col("name"))))
    c = cut_lineage(with_name_scores(c).drop("sc").withColumn("score", composite_score(F.col("ns"), F.col("target_amount"), F.col("amount"))))
    # the best payroll employee of each client: one small aggregate joined back, no sort of a client's employees
    best = c.filter(F.col("score") >= CONTEXT_THRESHOLD).groupBy("unified_name").agg(
        F.min(F.struct(-F.col("score"), -F.col("ns"), "name"))["name"].alias("best"))
    c = c.join(best, "unified_name", "left").withColumn("rk", F.when(F.col("name") == F.col("best"), 1))
    sec4 = _pad(c.select(F.lit("candidate").alias("section"), F.col("unified_name").alias("client_name"),
                         F.lit("payroll").alias("side"), F.col("name").alias("employee"), "amount", "target",
                         "target_amount", F.round("score", 6).alias("score"),
                         F.coalesce(F.col("rk") == 1, F.lit(False)).alias("is_match"),
                         F.when(F.col("rk") == 1, F.abs(F.col("target_amount") - F.col("amount")))
                         .alias("amount_diff")))
    return sec1.unionByName(sec2).unionByName(sec3).unionByName(sec4)
