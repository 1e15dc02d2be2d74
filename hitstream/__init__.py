"""Analytics over detector-array data on Spark: hits, traces, telemetry and text corpora."""
