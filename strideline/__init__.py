"""Load-test and latency analytics as Spark DataFrame operators."""
