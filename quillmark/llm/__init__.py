"""Operators of a training-data pipeline: each module is one operator; ``queries`` registers them.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
