"""Training-data operators: mixing, quality, tokens, chat, dedup, PII, packing, search, HTML.

Each module holds one operator with a general interface; ``queries`` binds the
operators to the ``opN_<name>`` queries.  Nothing outside this subpackage
imports it.
"""
