"""Operators that prepare text for language-model training.

Nothing else in the library imports this package. Each module holds one operator with a general
interface; ``queries`` registers the thin queries that apply them to whole tables.
"""
