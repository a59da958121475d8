"""Graph-query algebra compiled to DataFrames."""
