"""Analytics over experiment runs, expressed as Spark DataFrames and streams."""
