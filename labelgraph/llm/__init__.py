"""Training-data operators (secrets, joins, quality, language, packing, dedup, ...).

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
