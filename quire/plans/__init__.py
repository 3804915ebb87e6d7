"""Plans of the document-knowledge engine."""
