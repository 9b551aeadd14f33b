"""All queries of this subpackage."""

from newsflow.llm import alignment, decontaminate, langid, lm, merkle, mixing, quality, secrets, sharding, simhash, token_counts, topk, warc  # noqa: F401
from newsflow.llm.common import QUERIES

__all__ = ["QUERIES"]
