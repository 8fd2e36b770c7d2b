"""Small helpers for expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col_of(c), F.lit(" \t\r\n\f\u000b"))


def lookup(table: dict, key) -> Column:
    """Value of a small fixed table for ``key``; NULL when the key is not in it."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(entries, col_of(key))


def keyed_hash(seed: int, *cols) -> Column:
    """A repeatable pseudo-random 64-bit number per row."""
    return F.xxhash64(F.lit(seed), *[col_of(c) for c in cols])
