"""Functions of the alignment analytics library."""
