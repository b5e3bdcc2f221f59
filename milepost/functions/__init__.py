"""Column functions: months, text, numbers."""
