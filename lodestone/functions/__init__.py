"""Subpackage of the engine; see README.md."""
