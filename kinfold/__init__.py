"""Relatedness analytics as PySpark DataFrame operators."""
