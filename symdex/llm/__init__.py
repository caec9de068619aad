"""Operators for preparing training text: filtering, deduplication, mixing, scoring, tokens.

Nothing else in the library imports this subpackage.
"""
