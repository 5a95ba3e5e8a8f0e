"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries.py`` holds
the thin registered queries.  Nothing outside this subpackage imports it.
"""
