"""functions of the tag mining library."""
