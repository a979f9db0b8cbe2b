"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_*`` queries. Nothing outside this package imports it."""
