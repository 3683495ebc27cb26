"""All queries of this subpackage."""

from __future__ import annotations

from threadloom.llm import q_corpus, q_records  # noqa: F401
from threadloom.llm.registry import QUERIES, SQL  # noqa: F401
