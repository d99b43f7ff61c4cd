"""Operators for preparing large training corpora.

Nothing outside this package imports it.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
