"""Column functions; none of them runs Python per row."""
