"""Operators for preparing training text; nothing else in textmill imports this package."""
