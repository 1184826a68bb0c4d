"""Text retrieval and text analytics on PySpark DataFrames."""
