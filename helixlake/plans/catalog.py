"""The registered queries of the analytics engine and their SQL."""

from . import q_audits, q_coordinates, q_joins, q_metrics, q_sequences, q_sources, q_streaming  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
