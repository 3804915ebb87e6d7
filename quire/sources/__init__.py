"""Sources of the document-knowledge engine."""
