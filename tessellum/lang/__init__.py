"""The index-notation language: parsing and program structure."""
