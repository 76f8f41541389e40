"""Scriptorium: a PySpark engine for libraries of long-form text."""
