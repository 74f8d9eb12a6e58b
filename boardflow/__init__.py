"""boardflow: board state spaces, graphs and layouts as Spark DataFrames."""
