"""Clinical-study data management as Spark DataFrame plans."""
