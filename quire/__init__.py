"""quire: a PySpark-native engine for document knowledge: blocks, graphs, chunks, quality figures and review queues."""

__version__ = "0.1.0"
