"""sources of the tag mining library."""
