"""Daily panel analytics as Spark DataFrame operators.

Every operator takes and returns a long table keyed by ``(ticker, date)``.
"""
