"""orrery: keyed, time-ordered measurement analytics on Spark DataFrames."""
