"""Operators for preparing training data: splits, mixes, duplicates, defects, tokens, leaks and repairs."""
