"""cuelake: timed-interval and text-quality analytics on Spark DataFrames."""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
