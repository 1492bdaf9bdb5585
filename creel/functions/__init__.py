"""Column-level helpers: missing-value rules, scalar expressions, column selection."""
