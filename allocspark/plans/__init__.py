"""Plans of the allocation analytics."""
