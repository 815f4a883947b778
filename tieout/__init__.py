"""tieout: two-ledger reconciliation on Spark (see README.md)."""
