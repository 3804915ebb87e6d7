"""Sinks of the document-knowledge engine."""
