"""The registered queries, by family."""

from rulewright.plans import evaluation_queries, filter_queries, label_queries, record_queries, retrieval_queries, rule_queries, session_queries, text_queries  # noqa: F401
from rulewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
