"""Sources of the audit engine."""
