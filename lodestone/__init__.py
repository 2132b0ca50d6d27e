"""lodestone: retrieval and memory analytics as Spark DataFrame transforms."""
