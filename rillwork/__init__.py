"""Rillwork: live-stream analytics, sequence repair, task graphs and upkeep of the store as Spark jobs."""
