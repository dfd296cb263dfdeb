"""Operators for large-scale training data.

Nothing outside this folder imports it. Every operator has its own module and
states there what it returns for nulls, empty texts, ties and repeated rows;
``registry`` has the queries that apply them to whole tables.
"""
