"""Corpus operators for language-model training data.

Nothing outside this subpackage imports it.  Each module is one operator with
a general interface; :mod:`maskwright.llm.catalog` holds the thin queries.
"""
