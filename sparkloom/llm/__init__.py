"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it. Every module holds one operator with a
general DataFrame interface; ``queries`` applies them to the standard tables.
"""
