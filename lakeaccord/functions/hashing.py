"""Seeded order: rows sorted by a digest of their key are in a repeatable random order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_DIGITS = 4
LAST_BUCKET = "f" * BUCKET_DIGITS


def order_hash(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def hash_bucket(digest: Column) -> Column:
    """The first digits of a digest: equal shares of rows, in digest order."""
    return F.substring(digest, 1, BUCKET_DIGITS)


LONG_VALUE = 64  # bytes; one less than the mark and the digest that stand for a longer value


def compact(value: str) -> str:
    """SQL for a string that is itself when short and a marked SHA-256 digest when long.

    Comparing compact values moves 65 bytes instead of a whole text. With its
    mark a digest is longer than any value that stands for itself, so that a
    long text never equals a short one, not even the one that is its digest.
    """
    return f"IF(octet_length({value}) > {LONG_VALUE}, concat('#', sha2({value}, 256)), {value})"
