"""Operators for preparing training text. Optional: nothing else in the library imports them."""
