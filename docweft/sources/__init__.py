"""Readers and writers by format."""

from .readers import READERS, read_source  # noqa: F401
from .writers import WRITERS, write_target  # noqa: F401
