"""Canonical decimal text and content hashes. Nulls are marked, so that they differ from any text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = "~"
DECIMAL = "decimal(38,18)"


def decimal_text(value: Column) -> Column:
    """Plain notation without trailing zeros, ``-0`` as ``0``; null where the text is no number of up to 38 digits."""
    plain = value.try_cast(DECIMAL).cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def marked(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(NULL))


def digest(columns: Sequence[Column], domain: str) -> Column:
    """``sha256:`` and hex of the columns in the given order, separated and null-aware, within a named domain."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", F.lit(domain), *map(marked, columns)), 256))


def folded(digests: Column) -> Column:
    """Hash of an ordered array of digests."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(digests, "\n"), 256))


def chained(digests: Column, start: str = "") -> Column:
    """Each digest hashed onto the one before, so that appending needs the last link only."""
    return F.aggregate(digests, F.lit(start), lambda link, x: F.sha2(F.concat_ws("\x1f", link, x), 256))
