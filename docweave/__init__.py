"""docweave: document intelligence and retrieval analytics as PySpark jobs."""
