"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the entry
module reach it from the repository top.
"""
