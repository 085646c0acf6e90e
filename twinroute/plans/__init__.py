"""Plans of the alignment analytics library."""
