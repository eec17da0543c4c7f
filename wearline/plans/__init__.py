"""Named queries: each has a Spark builder and, where SQL can express it, a DuckDB oracle."""
