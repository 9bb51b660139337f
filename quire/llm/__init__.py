"""Operators for preparing language-model training data.

Nothing outside this folder imports it except ``__spark_entry__`` (guarded) and
``corpus_pipeline``; deleting it leaves the rest of the library whole.
"""
