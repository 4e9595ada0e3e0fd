"""Whole runs and the registered queries."""
