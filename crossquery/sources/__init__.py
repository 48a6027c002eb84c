"""Sources that plans read: Parquet folders, DuckDB files, and databases over JDBC."""
