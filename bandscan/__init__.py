"""Approximate sequence matching as Spark DataFrame operators."""
