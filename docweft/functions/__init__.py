"""Verbs: each maps argument columns to one column. Importing this package registers them all."""

from . import aggregates, arrays, dates, encoding, finance, geo, logic, numeric, objects, strings, windows  # noqa: F401
from .values import Context, verb_names, verbs  # noqa: F401
