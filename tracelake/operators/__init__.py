"""Operators over typed events, completed calls, aggregates and value series."""
