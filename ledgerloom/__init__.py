"""Contract and billing analytics as Spark DataFrame operators."""
