"""Importing this module registers every query of the library."""

from . import books, causal, corpus, inference, kernels, learning, market, pairs, studies  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
