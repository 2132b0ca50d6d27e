"""Training-data operators: near-dedup, decontamination, scoring, tokens, sharding and filters.

Nothing outside this folder imports it.
"""
