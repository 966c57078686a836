"""Training-data operators: packing, search, deduplication, language models, filters, archives.

Nothing outside this package imports it.
"""
