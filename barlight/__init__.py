"""Market analytics and data processing as PySpark DataFrame plans."""
