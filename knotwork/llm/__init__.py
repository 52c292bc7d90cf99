"""Operators for text and code used as training data. Nothing else in the library imports this package."""
