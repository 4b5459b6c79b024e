"""Operators for preparing large text collections for model training.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
