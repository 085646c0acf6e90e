"""Sources of the alignment analytics library."""
