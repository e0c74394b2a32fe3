"""Scalar functions as built-in expressions, and vectorised Python functions for what built-ins lack."""
