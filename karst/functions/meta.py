"""The parts of record ids under their other names."""

from .record import id, table

tb = table
__all__ = ["id", "table", "tb"]
