"""Functions of the factloom engine."""
