"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, fingerprints, language_id, near_dedup, packing, quality, secrets, token_counts, toxicity

QUERIES = near_dedup.QUERIES | secrets.QUERIES | quality.QUERIES | {"op4_exact_dedup": exact_dedup.op4_exact_dedup} | byte_bpe.QUERIES | toxicity.QUERIES | fingerprints.QUERIES | packing.QUERIES | token_counts.QUERIES | language_id.QUERIES

ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE}
