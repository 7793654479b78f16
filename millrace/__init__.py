"""millrace: a model-first analytics engine that lowers to Spark DataFrames."""

__version__ = "0.1.0"
