"""Operators of a training-data pipeline over tables of documents.

Nothing outside this subpackage imports it, apart from the guarded registration
in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
