"""Tables: outside Parquet files, and managed tables with an operation log."""
