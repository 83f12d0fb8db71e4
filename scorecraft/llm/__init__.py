"""Operators for preparing large text corpora (see README, "Corpus operators").

Nothing outside this subpackage, its tests and ``corpus_pipeline.py`` imports it.
"""
