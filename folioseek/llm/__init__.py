"""Operators for preparing training data: quality, text extraction, privacy, tokens, duplicates, shards.

Nothing outside this folder imports it. Each module holds one operator with its own interface;
`queries` registers the thin queries over the given tables.
"""
