"""Streaming of the document-knowledge engine."""
