"""nearscore: nearest-neighbour risk scoring on Spark DataFrames."""

__version__ = "0.1.0"
