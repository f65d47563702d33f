"""Training-data operators on Spark DataFrames.

Nothing outside this package imports it.  Every operator is a function from
DataFrame to DataFrame; the registered queries are in ``queries``.
"""
