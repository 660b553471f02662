"""rankspark - hybrid retrieval, ranking and ranking evaluation as Spark jobs."""

__version__ = "0.1.0"
