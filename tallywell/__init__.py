"""Windowed extraction, a replayable raw layer, staging, marts and data assertions on Spark."""
