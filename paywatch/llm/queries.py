"""Imports every query module, which registers its query."""

from paywatch.llm import decontaminate_query, jaccard_query, language_query, line_dedup_query, main_text_query, manifest_query, mixing_query, near_dedup_query, neighbours_query, ngrams_query, pii_query, variants_query, warc_query  # noqa: F401
from paywatch.llm.registry import ORACLES, QUERIES  # noqa: F401
