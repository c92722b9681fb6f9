"""Market-microstructure features, labels and evaluation on Spark DataFrames."""
