"""The same signals raised as measurements arrive."""
