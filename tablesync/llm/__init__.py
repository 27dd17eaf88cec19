"""Operators that prepare training text, each with the queries that apply it."""
