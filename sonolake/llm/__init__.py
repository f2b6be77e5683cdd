"""Operators for preparing training text at scale. Nothing else in the library imports this package."""
