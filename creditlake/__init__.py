"""Consumer-credit analytics as Spark DataFrame transformations."""
