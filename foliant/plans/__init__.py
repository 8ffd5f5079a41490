"""Composed plans: the document pipeline and its record."""
