from skewprobe.functions.keys import is_hot, order_key
from skewprobe.functions.vectors import (
    block_bounds,
    block_scores,
    dim_blocks,
    dot,
    dot_scores,
    scores_of,
    search_cast,
    suffix_bounds,
)

__all__ = [
    "block_bounds",
    "block_scores",
    "dim_blocks",
    "dot",
    "dot_scores",
    "is_hot",
    "order_key",
    "scores_of",
    "search_cast",
    "suffix_bounds",
]
