"""Operators of a training-data pipeline. Nothing outside this package imports it.

Modules are imported by name; ``mailsieve.llm.queries`` holds the registered queries.
"""
