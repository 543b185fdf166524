"""Recurring jobs over event tables as Structured Streaming."""
