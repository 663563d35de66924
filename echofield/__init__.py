"""Point-cloud and sensor-stream analytics on Spark."""
