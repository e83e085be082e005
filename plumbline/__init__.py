"""Plumbline: evidence-backed table analysis as plain PySpark DataFrame operators."""
