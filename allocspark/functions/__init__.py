"""Functions of the allocation analytics."""
