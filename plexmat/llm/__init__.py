"""Operators for preparing training text; nothing else in the library imports this subpackage."""
