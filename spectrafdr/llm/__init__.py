"""Training-data operators: language, quality, duplicates, mixing, packing, search, tokens.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
