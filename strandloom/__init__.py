"""Read-set analytics expressed as Spark DataFrame plans."""
