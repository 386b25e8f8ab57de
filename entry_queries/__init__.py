"""Registered queries: each operator on the given tables, with the SQL that checks it."""

from . import charts, encoding, numeric, plans, profiles, rows, tables, text  # noqa: F401
from .common import REGISTERED

__all__ = ["REGISTERED"]
