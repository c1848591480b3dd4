"""Job-posting collection, entity resolution, scoring and review as PySpark DataFrames."""
