"""Operators that prepare text for training language models. Nothing else in quire imports this subpackage."""
