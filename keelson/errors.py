"""Errors of the library."""


class PlanError(ValueError):
    """A plan that cannot mean anything, found when it is built."""


class KeyClash(ValueError):
    """Rows that share a key where keys must be distinct."""
