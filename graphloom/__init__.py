"""Property-graph analytics of software on PySpark DataFrames."""
