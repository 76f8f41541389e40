"""Operators that prepare a library's text for training data. Nothing outside this package imports it."""
