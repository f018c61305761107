"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin registered queries built on them.
"""
