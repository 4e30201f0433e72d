"""Operators of a training-data pipeline for language models; nothing else in the library imports this subpackage."""

from skybias.llm import (bloom_lm, conversation_trie, embedding_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, quality,  # noqa: F401
                         separators, toxicity, whitening)
from skybias.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
