"""One module for each query opN_<name>: query(spark, sf_dir), and SQL where DuckDB can express it."""
