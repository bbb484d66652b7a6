"""Code-graph and retrieval analytics on Spark."""

__version__ = "0.1.0"
