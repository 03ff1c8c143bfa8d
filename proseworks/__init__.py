"""Text checking and corpus preparation as Spark DataFrame operators."""
