"""Column functions: no UDFs, every one runs inside the JVM."""
