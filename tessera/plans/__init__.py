"""Queries of the operators over the test tables; importing this fills the registry."""

from . import q_aggs, q_files, q_joins, q_more, q_search, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
