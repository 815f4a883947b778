"""Derived reconciliation fixtures over the driver's TPC-H-style tables.

The SQL below is written in the common subset of Spark SQL and DuckDB, so the
same text defines the fixture for our Spark queries and for the DuckDB oracle
(see FIXTURES.md). Register order matters: later views read earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Client class = cid % 9 (0 same name, 1 suffix, 2 upper, 3 extra words, 4 alias,
# 5 ledger only, 6 typo, 7 payroll only, 8 opposite-signed totals).
F_CLIENTS = """
SELECT cid,
  CASE WHEN cid % 9 = 7 THEN NULL WHEN cid % 9 = 5 THEN reverse(w1 || w2) ELSE w1 || ' ' || w2 END AS ledger_name,
  CASE cid % 9 WHEN 0 THEN w1 || ' ' || w2 WHEN 1 THEN w1 || ' ' || w2 || ', LLC' WHEN 2 THEN upper(w1 || ' ' || w2)
    WHEN 3 THEN w1 || ' ' || w2 || ' Holdings Group' WHEN 4 THEN 'Rule Alias ' || CAST(cid AS VARCHAR(9)) WHEN 5 THEN NULL
    WHEN 6 THEN w1 || ' ' || substr(w2, 1, 4) || 'x' || substr(w2, 5) WHEN 7 THEN w1 || ' ' || w2
    ELSE CASE WHEN cid % 2 = 0 THEN w1 || ' ' || w2 || ' Svc' ELSE w1 || ' Svc' || CAST(cid AS VARCHAR(9)) END END AS payroll_name
FROM (SELECT cid,
  split_part('Harbor,Summit,Keystone,Prairie,Granite,Cobalt,Falcon,Juniper,Wabash,Orchard,Beacon,Tundra', ',', cid % 12 + 1) AS w1,
  split_part('Mechanical,Electric,Roofing,Plumbing,Logistics,Foundry,Separation,Paving,Glassworks', ',', CAST(floor(cid / 12.0) AS INT) + 1) AS w2
  FROM (SELECT DISTINCT CAST(c_custkey % 108 AS INT) AS cid FROM customer) c) w
"""

F_BASE = """
SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, CAST(o.o_custkey % 108 AS INT) AS cid, CAST(l.l_suppkey % 24 AS INT) AS eid,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt, l.l_returnflag AS rf, o.o_orderpriority AS pr, o.o_orderstatus AS st,
  CAST(l.l_shipdate AS DATE) AS sd,
  split_part('Marta,Alonso,Hector,Juana,Ricardo,Imani,Pavel,Noor', ',', CAST(l.l_suppkey % 8 AS INT) + 1) AS fn,
  split_part('Mendoza,Vizcarra,Okafor', ',', CAST(floor((l.l_suppkey % 24) / 8.0) AS INT) + 1) AS sn
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

F_LEDGER = """
SELECT b.ok, b.ln, CASE WHEN eid % 3 = 0 THEN ledger_name || ':Site ' || CAST(eid AS VARCHAR(9))
    WHEN eid % 3 = 1 THEN ledger_name || '--Site ' || CAST(eid AS VARCHAR(9)) ELSE ledger_name END AS name,
  fn || ' ' || sn AS item, amt AS amount, CASE WHEN ok % 97 = 0 THEN 'n/a' ELSE CAST(amt AS VARCHAR(30)) END AS amount_text,
  CASE WHEN ln = 7 THEN '' ELSE st END AS type, rf AS account,
  CASE WHEN pr = '5-LOW' THEN '' ELSE pr END AS rep, CAST(ok AS VARCHAR(20)) AS po_number
FROM f_base b JOIN f_clients c ON b.cid = c.cid
WHERE ledger_name IS NOT NULL AND (b.cid % 9 = 8 OR (eid + b.cid) % 17 <> 0)
"""

F_PAYROLL = """
SELECT b.ok, b.ln, CASE WHEN (eid + b.cid) % 6 = 3 THEN replace(fn, 'a', 'o') ELSE fn END AS first_name,
  CASE WHEN (eid + b.cid) % 6 = 1 THEN sn || ' Salas' WHEN (eid + b.cid) % 6 = 2 THEN sn || '-Diaz' ELSE sn END AS last_name,
  payroll_name AS bill_to_name,
  CASE WHEN b.cid % 9 = 8 THEN -amt WHEN (b.cid + eid) % 7 = 0 THEN CAST(amt - 5.00 AS DECIMAL(18,2))
    WHEN (b.cid + eid) % 11 = 0 THEN CAST(amt * 3 AS DECIMAL(18,2)) ELSE amt END AS item_bill,
  CASE WHEN ok % 89 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(amt - 1.00 AS DECIMAL(18,2)) END AS item_pay, sd AS week_worked
FROM f_base b JOIN f_clients c ON b.cid = c.cid
WHERE payroll_name IS NOT NULL AND ln <> 7 AND (b.cid % 9 = 8 OR (eid + b.cid) % 13 <> 0)
"""

F_RULES = """
SELECT cid AS row_no, ledger_name AS name_a, payroll_name AS name_b FROM f_clients WHERE cid % 9 = 4
"""

F_DEPOSITS = """
SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'Deposit' END AS type,
  CASE WHEN c.cid % 2 = 0 THEN coalesce(ledger_name, payroll_name) ELSE coalesce(payroll_name, ledger_name) END AS client_name,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(1000 + o_orderkey AS VARCHAR(20)) ELSE '' END AS num,
  CASE WHEN o_orderkey % 1499 = 1498 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS amount_text,
  CAST(o_orderdate AS DATE) AS deposit_date
FROM orders o JOIN f_clients c ON CAST(o.o_custkey % 108 AS INT) = c.cid WHERE c.cid % 4 <> 0
"""

F_ORDER_LINES = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
  CASE l_partkey % 6 WHEN 0 THEN 'https://shop.example.com/x/dp/' || pid || '/ref=a' WHEN 1 THEN 'https://shop.example.com/gp/product/' || pid
    WHEN 2 THEN 'https://shop.example.com/i?x=1&asin=' || lower(pid) WHEN 3 THEN 'https://shop.example.com/gp/aw/d/' || pid
    WHEN 4 THEN ' ' ELSE 'https://shop.example.com/search?q=' || pid END AS product_link,
  CASE WHEN l_linenumber = 6 THEN 0 ELSE CAST(l_quantity AS INT) END AS quantity, 'Dock ' || l_returnflag AS ship_to,
  CASE WHEN l_linestatus = 'F' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date_needed
FROM (SELECT lineitem.*, 'B' || lpad(CAST(l_partkey % 4 AS VARCHAR(9)), 9, '0') AS pid FROM lineitem) l
"""

# payroll as text cells: bill-to names with the roll-up prefix, bill and date cells that do not parse
F_PAYROLL_TEXT = """
SELECT ok, ln, first_name, last_name,
  CASE WHEN ok % 5 = 0 THEN 'DART Entities ' || bill_to_name ELSE bill_to_name END AS bill_to_name,
  CASE WHEN ok % 101 = 0 THEN 'n/a' ELSE CAST(item_bill AS VARCHAR(30)) END AS item_bill, CAST(item_pay AS VARCHAR(30)) AS item_pay,
  CASE WHEN ok % 107 = 0 THEN 'unknown' ELSE CAST(week_worked AS VARCHAR(30)) END AS week_worked
FROM f_payroll
"""

# order lines with their requester
F_REQUESTS = """
SELECT f.*, CASE WHEN order_id % 13 = 0 THEN ' ' ELSE 'desk' || CAST(order_id AS VARCHAR(20)) || '@example.com' END AS email,
  CASE WHEN order_id % 17 = 0 THEN NULL ELSE 'Buyer ' || CAST(order_id AS VARCHAR(20)) END AS name,
  CASE WHEN order_id % 19 = 0 THEN '' ELSE 'Facilities' END AS department
FROM f_order_lines f
"""

FIXTURE_VIEWS = (
    ("f_clients", F_CLIENTS),
    ("f_base", F_BASE),
    ("f_ledger", F_LEDGER),
    ("f_payroll", F_PAYROLL),
    ("f_rules", F_RULES),
    ("f_deposits", F_DEPOSITS),
    ("f_order_lines", F_ORDER_LINES),
    ("f_payroll_text", F_PAYROLL_TEXT),
    ("f_requests", F_REQUESTS),
)

# Base tables each fixture needs; only these are scanned.
_NEEDS = {"customer", "lineitem", "orders"}


def register_base_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    for name in names or BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def register_fixtures(spark: SparkSession, sf_dir: str) -> None:
    """Register the base tables and every ``f_*`` fixture as temp views."""
    register_base_tables(spark, sf_dir, sorted(_NEEDS))
    for name, sql in FIXTURE_VIEWS:
        spark.sql(sql).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_fixtures(spark, sf_dir)
    return spark.table(name)


def fixture_ctes(extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """``WITH`` prefix defining every fixture (plus ``extra`` CTEs) for DuckDB."""
    parts = [f"{name} AS ({sql.strip()})" for name, sql in FIXTURE_VIEWS]
    # a trailing "!" on a CTE name asks DuckDB to materialise it once
    parts += [f"{name.rstrip('!')} AS {'MATERIALIZED ' if name.endswith('!') else ''}({sql.strip()})"
              for name, sql in (extra or [])]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
