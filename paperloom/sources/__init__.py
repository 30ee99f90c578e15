"""Files and web pages to items. ``read(spark, kind, path)`` is the registry of importers."""

from .files import KINDS, read, read_pages

__all__ = ["KINDS", "read", "read_pages"]
