"""Seeded order keys.

`rand(seed)` depends on the partitioning, so every random choice here is a digest of the seed and
the row's own key: the same rows are chosen on any cluster, and after any executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_PER_UNIT = 13  # hex digits of the digest that fit a double exactly (52 bits)


def seeded_digest(seed: int | str, *keys: Column) -> Column:
    """32 hex digits of md5('seed|key|key...')."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def digest_bucket(digest: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of a digest: 16**hex_digits even buckets in digest order, few beside the rows of a large table."""
    return F.substring(digest, 1, hex_digits)


def digest_uniform(digest: Column) -> Column:
    """The digest as a double in (0, 1)."""
    as_long = F.conv(F.substring(digest, 1, HEX_PER_UNIT), 16, 10).cast("double")
    return (as_long + F.lit(0.5)) / F.lit(float(16**HEX_PER_UNIT))


def digest_long(digest: Column, hex_digits: int = 15) -> Column:
    """Leading digits of a digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")
