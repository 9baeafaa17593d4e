"""Column expressions: no shuffles, no Python rows."""
