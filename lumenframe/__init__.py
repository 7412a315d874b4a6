"""lumenframe: typed expression graphs, spatial joins, keyed accumulation and procedural functions on Spark."""
