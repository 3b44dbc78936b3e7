"""The queries of this subpackage."""

from __future__ import annotations

from . import bpe_tree, conversation_repair, cross_polytope, line_dedup, packing, piece_agenda, pu_quality, quality_rules, ranked_search, sharding, simhash, substring_dedup, token_counts

_MODULES = (sharding, packing, substring_dedup, bpe_tree, simhash, token_counts, cross_polytope, pu_quality, quality_rules, line_dedup, conversation_repair, piece_agenda, ranked_search)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
