"""All registered queries; importing a module registers its queries."""

from . import answer_queries, eval_queries, graph_queries, ground_queries, retrieval_queries, source_queries, text_queries, vote_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
