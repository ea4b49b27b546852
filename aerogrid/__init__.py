"""Station-observation analytics expressed as Spark DataFrame operators."""
