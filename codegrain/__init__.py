"""codegrain: property-graph analytics on Spark DataFrames."""
