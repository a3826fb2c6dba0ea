"""airgrid: air-quality prediction tables as Spark jobs."""
