"""streaming of the tag mining library."""
