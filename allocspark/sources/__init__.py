"""Sources of the allocation analytics."""
