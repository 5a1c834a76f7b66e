"""Operators for preparing page texts as training data; nothing outside this folder imports it."""
