"""Region files as they arrive."""
