"""Flat and two-level pivots.

Every pivot is a hash aggregate with map-side partial aggregation, so the
shuffle carries one row per (partition, key) rather than per input row. The
two-level pivots are computed from the child aggregate (parents are summed
from children, not re-read from the rows) and returned flattened: one
``group`` row per parent plus one ``item`` row per child. The nested form
(``children`` array) is a display helper only, because a parent with very
many children would otherwise become one huge row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_SEP = " - "


def _flat(df: DataFrame, keys: list[str], measure: str, count=None) -> DataFrame:
    cnt = count if count is not None else F.count(F.lit(1))
    return (df.groupBy(*keys)
            .agg(F.sum(measure).cast("decimal(18,2)").alias("amount"),
                 F.count(F.lit(1)).alias("quantity"), cnt.alias("cnt"))
            .select(F.concat_ws(KEY_SEP, *[F.col(k) for k in keys]).alias("key"), *keys,
                    "amount", "quantity", "cnt"))


def ledger_client_item(ledger: DataFrame) -> DataFrame:
    """B1: (client, item): amount, quantity, cnt; key ``client - item``."""
    return _flat(ledger, ["name", "item"], "amount")


def ledger_rep_client(ledger: DataFrame) -> DataFrame:
    """B2: (rep, client) for rows with a rep."""
    return _flat(ledger.filter(F.col("rep") != ""), ["rep", "name"], "amount")


def ledger_invoices(ledger: DataFrame) -> DataFrame:
    """Per client; ``cnt`` = number of distinct types (approximate invoices)."""
    return _flat(ledger, ["name"], "amount", F.countDistinct("type"))


def ledger_employee_job_site(ledger: DataFrame) -> DataFrame:
    """(employee = item, job site = memo) for rows with a memo."""
    return _flat(ledger.filter(F.col("memo") != ""), ["item", "memo"], "amount")


def payroll_bill_to_employee(payroll: DataFrame) -> DataFrame:
    """Payroll (bill-to, employee) with the billed amount."""
    return _flat(payroll, ["bill_to_name", "name"], "item_bill")


def two_level(df: DataFrame, parent: str, child: str, measure: str) -> DataFrame:
    """B6-B8 flattened: ``level``, ``group_name``, ``key`` (child, null on group rows),
    ``amount``, ``quantity``, ``cnt`` and ``n_children`` (group rows)."""
    kids = (df.groupBy(parent, child)
            .agg(F.sum(measure).cast("decimal(18,2)").alias("amount"), F.count(F.lit(1)).alias("cnt")))
    groups = (kids.groupBy(parent)
              .agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.sum("cnt").alias("cnt"),
                   F.count(F.lit(1)).alias("n_children")))
    g = groups.select(F.lit("group").alias("level"), F.col(parent).alias("group_name"),
                      F.lit(None).cast("string").alias("key"), "amount",
                      F.col("cnt").alias("quantity"), "cnt", "n_children")
    k = kids.select(F.lit("item").alias("level"), F.col(parent).alias("group_name"),
                    F.col(child).alias("key"), "amount", F.col("cnt").alias("quantity"),
                    "cnt", F.lit(None).cast("long").alias("n_children"))
    return g.unionByName(k)


def ledger_client_item_tree(ledger: DataFrame) -> DataFrame:
    """Client -> item with subtotals."""
    return two_level(ledger, "name", "item", "amount")


def ledger_rep_client_tree(ledger: DataFrame) -> DataFrame:
    """Rep -> client for rows with a rep."""
    return two_level(ledger.filter(F.col("rep") != ""), "rep", "name", "amount")


def payroll_bill_to_tree(payroll: DataFrame) -> DataFrame:
    """Bill-to -> employee."""
    return two_level(payroll, "bill_to_name", "name", "item_bill")


def nested(tree: DataFrame) -> DataFrame:
    """Nested display form of a flattened tree: one row per group with a
    ``children`` array sorted by key (bounded by the group's distinct children)."""
    kids = (tree.filter(F.col("level") == "item")
            .groupBy("group_name")
            .agg(F.array_sort(F.collect_list(F.struct("key", "amount", "quantity", "cnt"))).alias("children")))
    groups = tree.filter(F.col("level") == "group").select(
        "group_name", F.col("amount").alias("total_amount"), F.col("cnt").alias("total_count"))
    return groups.join(kids, "group_name", "left")


def expanded_view(tree: DataFrame, expanded: list[str]) -> DataFrame:
    """Every group row, plus the child rows of the expanded groups."""
    return tree.filter((F.col("level") == "group") | F.col("group_name").isin(list(expanded)))


def tree_kpis(tree: DataFrame) -> DataFrame:
    """Parent count and total children count of a two-level pivot (one row)."""
    return tree.agg(F.sum(F.when(F.col("level") == "group", 1).otherwise(0)).cast("long").alias("n_groups"),
                    F.sum(F.when(F.col("level") == "item", 1).otherwise(0)).cast("long").alias("n_children"))


def flat_kpis(flat: DataFrame) -> DataFrame:
    """B16 for flat pivots: row count (and the amount total)."""
    return flat.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("decimal(18,2)").alias("total_amount"))


def sorted_flat(flat: DataFrame) -> DataFrame:
    """G4 for flat pivots: rows ordered by key (apply only at output)."""
    return flat.orderBy("key")


def sorted_tree(tree: DataFrame) -> DataFrame:
    """G4 for two-level pivots: groups by name, each followed by its children by key."""
    return tree.orderBy("group_name", "level", "key")
