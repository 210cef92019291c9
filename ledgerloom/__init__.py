"""Statement-ledger analytics as Spark DataFrame, SQL and window operations."""
