"""Schemas as rule columns: format checks, the schema text, and validation of tables."""

from .formats import FORMATS, is_format  # noqa: F401
from .rules import validate, validate_references  # noqa: F401
from .schema import parse_schema, serialize_schema  # noqa: F401
