"""Turn batches of text posts into clean, deduplicated tables of events, on Spark."""
