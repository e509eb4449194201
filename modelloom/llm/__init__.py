"""Operators that prepare training text for language models.

Each module holds one operator with its own interface; ``queries`` applies them to
the benchmark tables. Nothing outside this package imports it.
"""
