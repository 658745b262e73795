"""Field-report analytics as lazy Spark DataFrames."""
