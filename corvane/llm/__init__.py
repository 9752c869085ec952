"""Operators for preparing training data.

Everything here builds on public Spark APIs only; no other module of the
library imports this subpackage.
"""
