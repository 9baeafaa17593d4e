"""Operators for preparing large text corpora: deduplication, extraction, filtering, search, tokenising and packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
