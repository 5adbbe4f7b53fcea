"""DataFrame operators that group, join or search."""
