"""Column functions: texts, extents, vectors and scores.  All stay inside the JVM."""
