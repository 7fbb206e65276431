"""Panel, signal, text and ledger analytics as Spark DataFrame jobs."""
