"""Operators of the alignment analytics library."""
