"""Column expressions: every scalar rule is a JVM-side expression."""
