"""Lowering of statements to DataFrame operations."""
