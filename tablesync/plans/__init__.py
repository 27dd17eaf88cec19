"""Whole jobs composed from operators."""
