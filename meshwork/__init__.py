"""meshwork: attributed-network analytics on PySpark DataFrames."""
