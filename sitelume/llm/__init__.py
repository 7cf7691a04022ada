"""Training-data operators: search, scoring, mixing, dedup, packing, sharding.

Nothing outside this subpackage imports it; deleting it leaves the rest intact.
"""
