"""All queries of this package and their SQL checks."""

from corpusloom.llm import (  # noqa: F401  (importing registers the queries)
    byte_bpe, decontaminate, filter_audit, grade_model, lm_score, preference_format, quality_rules, ranked_search,
    simhash_dedup, suffix_dedup, token_rollups, toxicity, url_filter)
from corpusloom.llm.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
