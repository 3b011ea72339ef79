"""veinmap: structural queries over SQL transformation projects, on Spark DataFrames."""

__version__ = "0.1.0"
