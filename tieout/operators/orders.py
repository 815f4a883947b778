"""Order-request lines: product ids from links and per-order roll-ups (K1-K5).

One row per order line in, ordinary columns out. The cart link of an order is
built from its per-product totals (pre-aggregated per ``(order, product)``),
so the collected list per order is bounded by its distinct products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_ws

# Fixed values (must equal the reference for identical results) -----------------
PRODUCT_ID_PATTERN = r"(?i)(?:/(?:dp|gp/product|gp/aw/d|gp/offer-listing)/|[?&](?:ASIN|asin)=)([A-Z0-9]{10})"
CART_DOMAIN = "www.amazon.com"
CART_PATH = "/gp/aws/cart/add.html?"
CART_TAG = "&AssociateTag=yourtag-20"
QTY_MIN, QTY_MAX = 1, 1000
REQUESTER = ("email", "name", "department")
# ------------------------------------------------------------------------------


def product_id(url) -> Column:
    """K1: the 10-character product id after a known path or ``?/&ASIN=``, upper-cased."""
    u = F.col(url) if isinstance(url, str) else url
    hit = F.regexp_extract(trim_ws(u), PRODUCT_ID_PATTERN, 1)
    return F.when(is_blank(u), F.lit(None).cast("string")).otherwise(F.upper(F.nullif(hit, F.lit(""))))


def _with_ids(lines: DataFrame) -> DataFrame:
    """``product_id`` of the valid lines (link present, quantity >= 1, id found); null on all others."""
    valid = ~is_blank(F.col("product_link")) & (F.col("quantity") > 0)
    return lines.withColumn("product_id", F.when(valid, product_id("product_link")))


def _per_product(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id", "product_id").agg(F.sum("quantity").cast("long").alias("quantity"),
                                                       F.min("line_no").alias("first_line"))


def product_totals(lines: DataFrame) -> DataFrame:
    """K2: valid lines summed per (order, id)."""
    return _per_product(_with_ids(lines).filter(F.col("product_id").isNotNull()))


def cart_links(lines: DataFrame, domain: str = CART_DOMAIN) -> DataFrame:
    """K3: one cart link per order, products numbered in first-seen order; "" when none.

    One scan and two aggregates: lines without an id stay as the null product, so every order is still there."""
    t = _per_product(_with_ids(lines))
    slots = F.array_sort(F.collect_list(F.when(F.col("product_id").isNotNull(), F.struct("first_line", "product_id", "quantity"))))
    part = lambda x, i: F.concat(F.lit("ASIN."), (i + 1).cast("string"), F.lit("="), x["product_id"], F.lit("&Quantity."),
                                 (i + 1).cast("string"), F.lit("="), x["quantity"].cast("string"))
    link = F.concat(F.lit(f"https://{domain}{CART_PATH}"), F.array_join(F.transform("p", part), "&"), F.lit(CART_TAG))
    return t.groupBy("order_id").agg(slots.alias("p")).select(
        "order_id", F.when(F.size("p") > 0, link).otherwise("").alias("cart_link"))


def line_texts(lines: DataFrame) -> DataFrame:
    """K4: ``n. link | Qty: q | Ship To: s | Date Needed: MM/dd/yyyy`` for lines with a link."""
    date = F.coalesce(F.date_format("date_needed", "MM/dd/yyyy"), F.lit("N/A"))
    return lines.filter(~is_blank(F.col("product_link"))).select(
        "order_id", "line_no",
        F.concat(F.col("line_no").cast("string"), F.lit(". "), F.coalesce("product_link", F.lit("")),
                 F.lit(" | Qty: "), F.col("quantity").cast("string"), F.lit(" | Ship To: "),
                 F.coalesce("ship_to", F.lit("")), F.lit(" | Date Needed: "), date).alias("line_text"))


def constraint_violations(lines: DataFrame) -> DataFrame:
    """K5: one row per violated declared constraint of an order line. The requester's email, name and department are
    required too, where the lines carry those columns."""
    requester = [F.when(is_blank(F.col(c)), F.lit(f"{c} required")) for c in REQUESTER if c in lines.columns]
    rules = F.array(
        *requester,
        F.when(is_blank(F.col("product_link")), F.lit("product_link required")),
        F.when(is_blank(F.col("ship_to")), F.lit("ship_to required")),
        F.when((F.col("quantity") < QTY_MIN) | (F.col("quantity") > QTY_MAX), F.lit("quantity out of range")))
    return (lines.select("order_id", "line_no", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")))
