"""skein: property-graph analytics on Spark DataFrames."""
