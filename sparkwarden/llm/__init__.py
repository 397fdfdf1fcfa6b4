"""Operators for large training-data pipelines, one module per operator.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; ``corpus_pipeline`` at the repository top chains five of them.
"""
