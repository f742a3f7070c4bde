"""Training-data operators: archives, chat formats, shards, deduplication, tokenisers, filters.

Nothing outside this subpackage imports it.
"""
