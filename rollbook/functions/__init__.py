"""Column expressions; every one stays inside generated JVM code."""
