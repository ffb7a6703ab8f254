"""All queries of this subpackage: importing the operators fills the registry."""

from tidemark.llm import (  # noqa: F401
    conversation_repair,
    decontaminate,
    embedding_dedup,
    jaccard_join,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    quality,
    sentencepiece_scan,
    token_count,
    toxicity,
    warc,
)
from tidemark.llm.registry import ORACLES, QUERIES  # noqa: F401
