"""Column expressions, fixed values, lookups and vectorised UDFs."""
