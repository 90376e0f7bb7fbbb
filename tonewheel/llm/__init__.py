"""Operators for building training data out of large document collections.

Nothing else in the library imports this subpackage. ``registry`` binds each operator to the benchmark tables.
"""
