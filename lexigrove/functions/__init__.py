"""Column functions used by the operators."""
