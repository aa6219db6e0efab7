"""tidewatch: data preparation, drift monitoring and model evaluation on Spark DataFrames."""

__version__ = "0.1.0"
