"""Lectern: corpus analytics expressed as PySpark DataFrame operators."""
