"""Column expressions shared by the operators (JVM-side, no Python UDFs)."""
