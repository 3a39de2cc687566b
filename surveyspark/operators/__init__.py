"""DataFrame operators (columns passed as arguments)."""
