"""Spark-native market analytics: sources, functions, operators, plans and streams over DataFrames."""
