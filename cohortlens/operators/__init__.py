"""Operators, one module per stage of a study."""
