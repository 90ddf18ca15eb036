"""Operators of a large-scale training-data pipeline over documents, pages and conversations.

Nothing outside this folder imports it.
"""
