"""Operators that prepare text corpora for language-model training.

Each module holds one operator with its own general interface; ``queries`` derives the
registered digest queries from them. Nothing outside this subpackage imports it.
"""
