"""Column functions: parsing of messy values, and small numeric helpers."""
