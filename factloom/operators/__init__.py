"""Operators of the factloom engine."""
