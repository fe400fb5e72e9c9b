"""Operators for preparing training text at scale.

Each module holds one operator with its own interface; ``queries`` applies them to the driver's tables.
Nothing outside this package imports it.
"""
