"""Portfolio research, quote evidence and text scanning as Spark jobs."""
