"""Document screening, ranking and corpus preparation as Spark DataFrame operators."""
