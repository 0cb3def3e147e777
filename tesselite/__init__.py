"""A retrieval and training-data engine expressed as Spark plans."""

__version__ = "0.1.0"
