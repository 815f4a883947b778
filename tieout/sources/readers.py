"""Typed, cleaned ledger / payroll / deposit rows.

Each ``clean_*`` takes a raw DataFrame whose columns are either the source
headers (``Type``, ``Name``, ``Item Bill`` ...) or our neutral names, and
returns a lazily cleaned DataFrame. ``read_*`` wrap ``spark.read`` for CSV /
parquet extracts. Nothing is collected: missing columns are detected from the
schema at plan time, bad cells become NULL through ``try_cast`` and are
filtered, so cleaning is a single narrow stage that Spark pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (DEFAULT_ROLLUP_PREFIXES, clean_client_name, full_name, is_blank, job_site, money,
                              previous_sunday, rollup_prefix, text_cell, try_date)

# Source header -> our column name (fixed values: the source extracts' headers).
LEDGER_HEADERS = {"Type": "type", "Name": "name", "Item": "item", "Amount": "amount", "Account": "account",
                  "Rep": "rep", "P. O. #": "po_number"}
PAYROLL_HEADERS = {"Week Worked": "week_worked", "Item Bill": "item_bill", "Item Pay": "item_pay",
                   "FirstName": "first_name", "LastName": "last_name", "Bill To Name": "bill_to_name"}
DEPOSIT_HEADERS = {"Type": "type", "Name": "client_name", "Num": "num", "Amount": "amount", "Date": "deposit_date"}

LEDGER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("memo", T.StringType()),
    T.StructField("item", T.StringType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("type", T.StringType()), T.StructField("account", T.StringType()),
    T.StructField("rep", T.StringType()), T.StructField("po_number", T.StringType())])
PAYROLL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("bill_to_name", T.StringType()),
    T.StructField("item_bill", T.DecimalType(18, 2)), T.StructField("item_pay", T.DecimalType(18, 2)),
    T.StructField("week_worked", T.DateType())])
DEPOSIT_SCHEMA = T.StructType([
    T.StructField("client_name", T.StringType()), T.StructField("payment_method", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("deposit_date", T.DateType()),
    T.StructField("check_number", T.StringType()), T.StructField("row_idx", T.LongType())])
LEDGER_TOTALS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("memo", T.StringType()), T.StructField("item", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("amount", T.DecimalType(28, 2)),
    T.StructField("amount_min", T.DecimalType(18, 2)), T.StructField("n_rows", T.LongType())])
PAYROLL_TOTALS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("bill_to_name", T.StringType()),
    T.StructField("item_bill", T.DecimalType(28, 2)), T.StructField("n_rows", T.LongType())])


def _resolve(df: DataFrame, headers: dict[str, str], overrides: dict[str, str] | None) -> dict[str, str]:
    """Logical field -> physical column. Headers are matched after trimming;
    a duplicated header keeps the last column (as a header dictionary would).
    Spark's CSV reader adds its position to each name of a duplicated header: that suffix is taken off again."""
    found: dict[str, str] = {}
    stripped = {c.strip() for c in df.columns}
    for at, phys in enumerate(df.columns):
        key = phys.strip()
        plain = key.removesuffix(str(at)).strip()
        if key not in headers and plain != key and plain in headers and plain not in stripped:
            key = plain
        if key in headers:
            found[headers[key]] = phys
        elif key in headers.values():
            found.setdefault(key, phys)
    for logical, phys in (overrides or {}).items():
        found[logical] = phys
    return found


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _t(df: DataFrame, name: str):
    return df.schema[name].dataType


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def clean_ledger(raw: DataFrame, columns: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """A1 + A4 + A5 + A8 + A9: typed ledger rows.

    Rows with a blank ``Type`` are dropped (totals, spacers); so is every row
    when there is no ``Type`` (or no ``Name``) column. ``Amount`` must parse,
    else the row is dropped; absent optional columns default to ``""`` / 0.
    ``keep`` passes extra raw columns through (e.g. a row id).
    """
    m = _resolve(raw, LEDGER_HEADERS, columns)
    if "type" not in m or "name" not in m:
        return _empty(raw.sparkSession, LEDGER_SCHEMA)

    def opt(field: str) -> Column:
        return text_cell(_c(m[field])) if field in m else F.lit("")

    name = text_cell(_c(m["name"]))
    amount = money(_c(m["amount"]), _t(raw, m["amount"])) if "amount" in m else F.lit(0).cast("decimal(18,2)")
    out = raw.filter(~is_blank(_c(m["type"]))).select(
        clean_client_name(name).alias("name"), job_site(name).alias("memo"), opt("item").alias("item"),
        amount.alias("amount"), text_cell(_c(m["type"])).alias("type"), opt("account").alias("account"),
        opt("rep").alias("rep"), opt("po_number").alias("po_number"), *[_c(k) for k in (keep or [])])
    return out.filter(F.col("amount").isNotNull())


def ledger_totals(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of :func:`clean_ledger` summed up: ``name, memo, item, type`` with ``amount`` (sum), ``amount_min`` and ``n_rows``.

    Rows are summed by their raw cells in one map-side-combined aggregation, and each distinct cell is cleaned once. Cells that clean
    to the same text leave several rows with the same names: what reads totals adds them up (``operators.totals``)."""
    m = _resolve(raw, LEDGER_HEADERS, columns)
    if "type" not in m or "name" not in m:
        return _empty(raw.sparkSession, LEDGER_TOTALS_SCHEMA)
    cells = raw.filter(~is_blank(_c(m["type"]))).select(
        *[(_c(m[k]).cast("string") if k in m else F.lit("")).alias(k) for k in ("name", "item", "type")],
        (money(_c(m["amount"]), _t(raw, m["amount"])) if "amount" in m else F.lit(0).cast("decimal(18,2)")).alias("cents"))
    # an amount that does not parse is null: sum, minimum and count leave it out (a filter would parse every amount twice)
    sums = cells.groupBy("name", "item", "type").agg(F.sum("cents").alias("amount"), F.min("cents").alias("amount_min"),
                                                     F.count("cents").alias("n_rows"))
    name = text_cell("name")
    return sums.filter("n_rows > 0").select(
        clean_client_name(name).alias("name"), job_site(name).alias("memo"), text_cell("item").alias("item"),
        text_cell("type").alias("type"), "amount", "amount_min", "n_rows")


def ledger_rejects(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A5 companion: non-blank-type rows whose amount cell does not parse."""
    m = _resolve(raw, LEDGER_HEADERS, columns)
    if "type" not in m or "name" not in m or "amount" not in m:
        return raw.limit(0)
    return raw.filter(~is_blank(_c(m["type"])) & money(_c(m["amount"]), _t(raw, m["amount"])).isNull())


def clean_payroll(raw: DataFrame, columns: dict[str, str] | None = None, *, week_of=None,
                  split_zero: bool = False, rollup_prefixes=DEFAULT_ROLLUP_PREFIXES,
                  keep: list[str] | None = None) -> DataFrame:
    """A2 + A5 + A7 + A10 + A11 (+ opt-in A12/A13).

    All six columns are required; if one is missing the result is empty (no
    error). ``week_of`` (a date or date string) keeps only rows of that
    processing week (Sunday-based, C24) - off by default, as in the source.
    ``split_zero=True`` keeps only rows with non-zero bill and pay (A13); the
    complement is :func:`payroll_zero_rows`.
    """
    m = _resolve(raw, PAYROLL_HEADERS, columns)
    if any(k not in m for k in PAYROLL_HEADERS.values()):
        return _empty(raw.sparkSession, PAYROLL_SCHEMA)
    out = raw.select(
        full_name(_c(m["first_name"]), _c(m["last_name"])).alias("name"),
        rollup_prefix(text_cell(_c(m["bill_to_name"])), rollup_prefixes).alias("bill_to_name"),
        money(_c(m["item_bill"]), _t(raw, m["item_bill"])).alias("item_bill"),
        money(_c(m["item_pay"]), _t(raw, m["item_pay"])).alias("item_pay"),
        try_date(_c(m["week_worked"]), _t(raw, m["week_worked"])).alias("week_worked"),
        *[_c(k) for k in (keep or [])])
    out = out.filter(F.col("item_bill").isNotNull() & F.col("item_pay").isNotNull()
                     & F.col("week_worked").isNotNull())
    if week_of is not None:
        out = out.filter(previous_sunday("week_worked") == previous_sunday(F.lit(week_of).cast("date")))
    if split_zero:
        out = out.filter((F.col("item_bill") != 0) & (F.col("item_pay") != 0))
    return out


def payroll_totals(raw: DataFrame, columns: dict[str, str] | None = None, rollup_prefixes=DEFAULT_ROLLUP_PREFIXES) -> DataFrame:
    """The rows of :func:`clean_payroll` summed up like :func:`ledger_totals`: ``name, bill_to_name`` with ``item_bill`` (sum) and ``n_rows``."""
    m = _resolve(raw, PAYROLL_HEADERS, columns)
    if any(k not in m for k in PAYROLL_HEADERS.values()):
        return _empty(raw.sparkSession, PAYROLL_TOTALS_SCHEMA)
    names = ("first_name", "last_name", "bill_to_name")
    cells = raw.select(
        *[_c(m[k]).cast("string").alias(k) for k in names], money(_c(m["item_bill"]), _t(raw, m["item_bill"])).alias("cents"),
        money(_c(m["item_pay"]), _t(raw, m["item_pay"])).alias("item_pay"),
        try_date(_c(m["week_worked"]), _t(raw, m["week_worked"])).alias("week_worked"))
    whole = F.when(F.col("item_pay").isNotNull() & F.col("week_worked").isNotNull(), F.col("cents"))
    sums = cells.groupBy(*names).agg(F.sum(whole).alias("item_bill"), F.count(whole).alias("n_rows"))
    return sums.filter("n_rows > 0").select(
        full_name("first_name", "last_name").alias("name"),
        rollup_prefix(text_cell("bill_to_name"), rollup_prefixes).alias("bill_to_name"), "item_bill", "n_rows")


def payroll_rejects(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A5 companion: raw payroll rows with a bill, pay or date cell that does not parse."""
    m = _resolve(raw, PAYROLL_HEADERS, columns)
    if any(k not in m for k in PAYROLL_HEADERS.values()):
        return raw.limit(0)
    return raw.filter(money(_c(m["item_bill"]), _t(raw, m["item_bill"])).isNull() | money(_c(m["item_pay"]), _t(raw, m["item_pay"])).isNull()
                      | try_date(_c(m["week_worked"]), _t(raw, m["week_worked"])).isNull())


def payroll_zero_rows(payroll: DataFrame) -> DataFrame:
    """A13 complement: cleaned payroll rows with a zero bill or pay amount."""
    return payroll.filter((F.col("item_bill") == 0) | (F.col("item_pay") == 0))


def clean_deposits(raw: DataFrame, columns: dict[str, str] | None = None, row_idx: str = "row_idx") -> DataFrame:
    """A3 + A4 + A6 + A14: deposit rows with their payment method.

    The source stops at the first non-blank row whose amount or date fails
    to convert and keeps only the rows before it. That cut-off is one scalar
    (``min(row_idx)`` of bad rows) computed as a scalar subquery - no row
    leaves the executors.
    """
    m = _resolve(raw, DEPOSIT_HEADERS, columns)
    if any(k not in m for k in ("type", "client_name", "amount", "deposit_date")) or row_idx not in raw.columns:
        key = raw.schema[row_idx].dataType if row_idx in raw.columns else T.LongType()
        return _empty(raw.sparkSession, T.StructType([*DEPOSIT_SCHEMA.fields[:-1], T.StructField("row_idx", key)]))
    typed = raw.filter(~is_blank(_c(m["type"]))).select(
        text_cell(_c(m["client_name"])).alias("client_name"),
        (text_cell(_c(m["num"])) if "num" in m else F.lit("")).alias("num"),
        money(_c(m["amount"]), _t(raw, m["amount"])).alias("amount"),
        try_date(_c(m["deposit_date"]), _t(raw, m["deposit_date"])).alias("deposit_date"),
        _c(row_idx).alias("row_idx"))
    first_bad = (typed.filter(F.col("amount").isNull() | F.col("deposit_date").isNull())
                 .agg(F.min("row_idx")).scalar())
    kept = typed.filter(first_bad.isNull() | (F.col("row_idx") < first_bad))
    return kept.select(
        "client_name",
        F.when(F.col("num") != "", F.lit("Check")).otherwise(F.lit("ACH")).alias("payment_method"),
        "amount", "deposit_date", F.col("num").alias("check_number"), "row_idx")


def deposit_rejects(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A5/A6 companion: non-blank deposit rows whose amount or date does not convert (the first one ends the file)."""
    m = _resolve(raw, DEPOSIT_HEADERS, columns)
    if any(k not in m for k in ("type", "client_name", "amount", "deposit_date")):
        return raw.limit(0)
    return raw.filter(~is_blank(_c(m["type"])) & (money(_c(m["amount"]), _t(raw, m["amount"])).isNull()
                                                  | try_date(_c(m["deposit_date"]), _t(raw, m["deposit_date"])).isNull()))


# --- readers ------------------------------------------------------------------

def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """An extract without even a header row raises."""
    if fmt == "csv":
        # every cell as text; cleaning does the typing
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    if not raw.columns:
        raise ValueError(f"{path} is empty: no header row")
    return raw


def read_ledger(spark: SparkSession, path: str, fmt: str = "csv", **kw) -> DataFrame:
    return clean_ledger(_read(spark, path, fmt), **kw)


def read_payroll(spark: SparkSession, path: str, fmt: str = "csv", **kw) -> DataFrame:
    return clean_payroll(_read(spark, path, fmt), **kw)


def read_deposits(spark: SparkSession, path: str, fmt: str = "csv", **kw) -> DataFrame:
    """Row order = file order: ``row_idx`` is (file path, start of the scanned block, row), so files come in path order
    and rows in file order however Spark packs files into tasks. Parquet numbers its rows itself; within one block of a CSV
    file the running id only has to increase, which it does as a block is read by one task."""
    raw = _read(spark, path, fmt)
    if "row_idx" not in raw.columns:
        file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        if fmt == "parquet":
            key = F.struct(file.alias("file"), F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row"))
        else:
            key = F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row"))
        raw = raw.select("*", key.alias("row_idx"))
    return clean_deposits(raw, **kw)
