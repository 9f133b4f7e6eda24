"""Catalogue analytics and hybrid retrieval expressed as Spark jobs."""

__version__ = "0.1.0"
