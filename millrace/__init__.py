"""Many graph queries at once on PySpark: graphs, queries and their states are DataFrames."""
