"""Operators that prepare training data for language models, at corpus scale."""
