"""Training-data operators: deduplication, secrets, quality, language, packing, archives, vectors.

Nothing outside this package imports it.  Every module has a general operator and a thin
``opN_*`` query in :mod:`ragframe.llm.queries` that applies it to a whole table.
"""
