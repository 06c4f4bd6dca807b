"""Streaming of the factloom engine."""
