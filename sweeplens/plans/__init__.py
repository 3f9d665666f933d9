"""Derived inputs and the registered query catalogue."""
