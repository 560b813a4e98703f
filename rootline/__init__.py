"""Lineage analytics and large-table reshaping on Spark.

``rootline`` answers questions about the lineage of data pipelines (which steps ran, with what
metadata, from which parents, producing which files) and reshapes the tables such pipelines leave
behind.  Every operator is a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
