"""Scalar and text expressions; all stay inside the JVM."""
