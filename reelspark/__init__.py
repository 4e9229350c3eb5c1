"""Media-timeline analytics and training-data preparation on PySpark DataFrames."""
