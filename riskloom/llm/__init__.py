"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing outside this package imports it; it can be removed without touching the analytics engine.
"""
