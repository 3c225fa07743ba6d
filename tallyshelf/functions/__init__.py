"""Column-level helpers shared by the operators; every one is a built-in Spark expression."""
