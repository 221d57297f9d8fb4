"""Segmentation-data analytics as Spark jobs."""
