"""weir: corpus curation and analytics on PySpark DataFrames."""
