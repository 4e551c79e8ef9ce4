"""All queries of the reference's operators; importing the modules registers them."""

from . import corpus_queries, dialogue_queries, evaluation_queries, search_queries, store_queries, stream_queries, web_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
