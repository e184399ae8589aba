"""Click-log feature engineering and embedding analytics as Spark DataFrame operators."""
