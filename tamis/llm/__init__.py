"""Operators for text and matching in training data; nothing outside this package imports it."""
