"""vitaplate: plate and object analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from Catalyst
expressions, joins, aggregates and windows, meant to be chained with
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming", "session"]
