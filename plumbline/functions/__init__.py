"""Scalar functions over terms, all of them JVM expressions."""
