"""Plans of the factloom engine."""
