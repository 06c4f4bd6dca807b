"""Relational analytics over code-behaviour facts, expressed with the Spark DataFrame API."""
