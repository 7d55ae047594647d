"""Streams of jobs."""
