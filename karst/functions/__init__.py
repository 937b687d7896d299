"""Functions over columns, one module for each family.

Arguments named as columns take a column or a column's name; plain values stay
values.  Everything is a built-in Spark expression unless its docstring says that
it is a pandas UDF.
"""

from . import array, bytes_, count, crypto, duration, encoding, files, geo, http, math, meta, ml, object_, parse, rand, record, search, sequence, session, set_, sql, string, time, type_, value, vector
from .sql import negate

__all__ = ["array", "bytes_", "count", "crypto", "duration", "encoding", "files", "geo", "http", "math", "meta", "ml", "negate", "object_", "parse", "rand", "record", "search", "sequence", "session", "set_", "sql", "string", "time", "type_", "value", "vector"]
