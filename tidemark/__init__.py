"""Change analysis on Spark: code changes as tables, review questions as queries."""
