"""plans of the tag mining library."""
