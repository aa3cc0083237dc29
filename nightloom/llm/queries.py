"""Importing this module registers every query of the subpackage."""
from . import (  # noqa: F401
    centroids,
    decontaminate,
    exact_dedup,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    topk,
    url_filter,
)
from .registry import ORACLES, QUERIES  # noqa: F401
