"""Independent SQL oracle (DuckDB dialect) for the registered jobs."""
