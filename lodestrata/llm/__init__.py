"""Operators that prepare source code and texts as training data."""
