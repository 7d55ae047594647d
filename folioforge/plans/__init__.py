"""Whole pipelines, and the queries of the driver contract."""
