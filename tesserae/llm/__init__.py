"""Training-data operators: packing, privacy, quality, language, deduplication, mixing, chat.

Nothing outside this subpackage imports it.
"""
