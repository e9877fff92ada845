"""Analytics over system-call I/O traces, as Spark DataFrame and Structured Streaming jobs."""
