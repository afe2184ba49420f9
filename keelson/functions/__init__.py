"""Scalar expressions and folds."""
