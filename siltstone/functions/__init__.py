"""Column builders and Arrow functions."""
