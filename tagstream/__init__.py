"""Label reading from camera frames as Spark DataFrame operators."""
