"""Functions of the document-knowledge engine."""
