"""colquarry: profiling and data-quality operators for Parquet datasets, on PySpark."""
