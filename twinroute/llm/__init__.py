"""Training-data operators: formatting, packing, dedup, filters and models over text tables.

Nothing outside this subpackage imports it.
"""
