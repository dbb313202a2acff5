"""Training-data operators: licences, chat pairs, page text, shards, decontamination, tokens, near copies, quality, PII.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; ``queries`` binds the operators to the given tables.
"""
