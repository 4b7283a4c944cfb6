"""Repeatable uniform numbers by the hash of a key: the same in any partitioning, after any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str | Column) -> Column:
    """In [0, 1): the first 32 bits of an MD5 of the key's text and the seed."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), seed if isinstance(seed, Column) else F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
