"""Storage and input."""
