"""The fixed fifth of the documents from which nothing is learned."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text is divisible by 5. A null id counts as empty text, and so is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
