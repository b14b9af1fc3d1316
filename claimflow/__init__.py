"""PySpark jobs for high-volume reply processing: DataFrame in, DataFrame out."""
