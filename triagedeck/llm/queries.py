"""Imports every operator of the subpackage, which registers its query."""

from . import (  # noqa: F401
    context_trees,
    conversations,
    embedding_dedup,
    fingerprints,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    token_counts,
    token_files,
)
from .base import ORACLES, QUERIES  # noqa: F401
