"""Document retrieval analytics as plain Spark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
