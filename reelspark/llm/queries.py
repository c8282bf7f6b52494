"""All queries of the subpackage."""

from reelspark.llm import queries_pairs, queries_sequences, queries_text
from reelspark.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries_pairs", "queries_sequences", "queries_text"]
