"""operators of the tag mining library."""
