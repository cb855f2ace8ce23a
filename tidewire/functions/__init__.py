"""Column functions, one module per kind of value."""
