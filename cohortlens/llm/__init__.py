"""Operators for preparing training text, and their registered queries.

Nothing else in the package imports this subpackage. ``queries`` holds the registered
queries and their SQL; every other module is one operator or a helper of several.
"""
