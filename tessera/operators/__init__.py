"""Operators on datasets: conditions, redaction, combination."""
