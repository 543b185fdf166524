"""Spark jobs for equity factor research."""
