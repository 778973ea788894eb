"""Training-data operators: license scans, quality rules, packing, de-duplication, tokenising and filters.

Nothing outside this folder imports it; the query registry in ``paperloom.llm.queries`` is the only way in.
"""
