"""Syntax checking by generalised LL recognition."""
