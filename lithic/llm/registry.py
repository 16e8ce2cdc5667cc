"""All queries of the training-data operators."""

from lithic.llm import queries_ann, queries_license, queries_middle, queries_negatives, queries_packing, queries_pieces, queries_pii, queries_quality, queries_sharding, queries_simhash, queries_suffix, queries_topk, queries_toxicity

_MODULES = (queries_toxicity, queries_ann, queries_topk, queries_suffix, queries_pii, queries_license, queries_simhash, queries_pieces, queries_quality, queries_packing, queries_sharding, queries_negatives, queries_middle)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
