"""Operators of the document-knowledge engine."""
