"""Record-resolution analytics as Spark DataFrame operators."""
