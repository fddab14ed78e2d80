"""Cross-store price analytics as Spark DataFrame operators."""
