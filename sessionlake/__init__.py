"""Session-log analytics as Spark DataFrame operators."""
