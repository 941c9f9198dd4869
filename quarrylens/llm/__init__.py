"""Operators for training-data work on code and text."""
