"""Column expressions: text rules of the retrieval service, all inside the JVM."""
