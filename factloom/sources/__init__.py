"""Sources of the factloom engine."""
