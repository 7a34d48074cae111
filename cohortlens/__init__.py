"""Longitudinal, right-censored cohort analytics as PySpark DataFrame operators.

Every operator takes a DataFrame plus column names and returns a lazy DataFrame.
Nothing in here assumes a fixed schema; see ``sources.tables`` for the explicit
schemas the catalogue and the examples read with.
"""
