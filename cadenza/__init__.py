"""Signal, feature and corpus analytics expressed as Spark jobs."""
