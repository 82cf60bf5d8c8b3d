"""Reusable DataFrame operators (all JVM-side, no Python UDFs)."""
