"""An analytics engine on Spark: SQL, snapshot tables, ingest and maintenance as DataFrames."""
