"""Basketry: rule checking over small item baskets, and text-corpus operators, on PySpark."""
