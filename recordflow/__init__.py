"""recordflow: an analytics engine for record streams, on Spark DataFrames."""
