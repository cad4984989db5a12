"""Operators for preparing text corpora at cluster scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``registry`` holds the thin ``opN_*`` queries and their SQL.
"""
