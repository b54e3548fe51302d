"""murmuration: discovery of recurring types in segmented vector sequences, on Spark DataFrames."""
