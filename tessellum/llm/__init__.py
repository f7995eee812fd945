"""Operators for preparing large text collections. Nothing outside this subpackage imports it."""
