"""Column functions: addresses, text, days, numbers."""
