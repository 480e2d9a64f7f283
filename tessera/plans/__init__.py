"""Composed flows of operators over the driver tables."""
