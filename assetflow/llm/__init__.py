"""Operators for preparing text and vectors for language-model training."""
