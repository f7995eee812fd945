"""Tensors from tables, and results to tables."""

from tessellum.sources.tables import read_tensor, write_results, write_tensor

__all__ = ["read_tensor", "write_results", "write_tensor"]
