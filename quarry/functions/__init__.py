"""Functions of the audit engine."""
