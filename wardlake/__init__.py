"""Spark-native analytics for endpoint security telemetry."""
