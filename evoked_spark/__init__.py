"""Spark jobs for event-related multi-channel signal data."""
