"""Column expressions for sampling order and label classes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label patterns that make a query hot, and the seed.
HOT_PATTERNS = ("DDoS", "DoS")
SEED = 42


def order_key(id_col: str | Column, seed: int = SEED) -> Column:
    """Repeatable random order of ids: the first 60 bits of ``md5(seed:id)``.

    It depends on the id only, not on partitions or row order, so every pass
    over the data and every retried task sees the same order. Rows of one id tie; a null id
    stands with the empty one.
    """
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(ident.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def is_hot(label: str | Column, patterns: Sequence[str] = HOT_PATTERNS) -> Column:
    """True when the label contains one of the patterns, in any case; null is cold."""
    text = F.lower(F.col(label) if isinstance(label, str) else label)
    hits = [text.contains(p.lower()) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))
