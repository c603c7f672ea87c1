"""Operators for preparing language-model training data. Nothing else in weir imports this."""
