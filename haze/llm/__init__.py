"""Operators for preparing training text: tokenising, deduplication, filtering and scanning.

Each module holds one operator with a general interface; ``queries`` derives
the registered results from them and ``corpus_pipeline`` at the repository
top chains five of them.
"""
