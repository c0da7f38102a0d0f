"""Column expressions over text, ids and vectors. All of them run on the JVM."""
