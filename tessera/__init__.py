"""A knowledge-graph analytics engine written for Spark DataFrames."""
