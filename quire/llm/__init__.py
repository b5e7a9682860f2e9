"""Operators on text for training data; nothing outside this folder imports it."""
