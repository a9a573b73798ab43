"""Operators of the allocation analytics."""
