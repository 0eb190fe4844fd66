"""Queries made of the operators, as the driver runs them."""
