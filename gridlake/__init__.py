"""gridlake: range-partitioned tables, planned and moved with plain Spark DataFrames."""

__version__ = "0.1.0"
