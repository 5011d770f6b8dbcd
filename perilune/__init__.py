"""Orbital-imaging analytics on PySpark: composable DataFrame operators."""
