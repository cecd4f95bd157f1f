"""Operators that prepare training text. Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it."""
