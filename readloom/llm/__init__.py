"""Training-data operators (quality, deduplication, mixing, packing, language models, search, chat formats).

Nothing outside this subpackage imports it.
"""
