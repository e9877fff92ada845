"""Whole jobs: from events to completed calls, and the registered queries."""
