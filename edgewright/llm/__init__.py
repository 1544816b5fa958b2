"""Operators for preparing training text, with their queries; nothing else in the library imports this package."""
