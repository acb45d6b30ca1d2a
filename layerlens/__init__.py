"""Storage-layout and log analytics, expressed as Spark jobs."""
