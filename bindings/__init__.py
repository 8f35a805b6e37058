"""Bindings of the library's operators to the driver tables."""

from . import q_changes, q_cluster, q_filters, q_search, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
