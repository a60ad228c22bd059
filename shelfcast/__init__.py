"""Daily demand forecasting and replenishment on Spark DataFrames."""

__version__ = "0.1.0"
