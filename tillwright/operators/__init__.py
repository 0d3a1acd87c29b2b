"""Reusable DataFrame operators that the report plans are declared with."""
