"""Contract-checked text-record analytics on PySpark DataFrames."""
