"""Scalar functions of the language as column expressions."""
