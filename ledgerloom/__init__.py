"""Receipt and payment-slip analytics as Spark DataFrame transformations."""
