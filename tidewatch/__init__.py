"""tidewatch: detection-timeline analytics and training-data preparation on Spark DataFrames."""
