"""Queries composed of the library's operators."""
