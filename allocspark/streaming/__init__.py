"""Streaming of the allocation analytics."""
