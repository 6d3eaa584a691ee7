"""Security-event analytics as Spark DataFrame functions."""
