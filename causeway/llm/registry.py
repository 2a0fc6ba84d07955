"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from causeway.llm import clusters, negatives, urls
from causeway.llm.bpe import op4_bpe_duckdb
from causeway.llm.clusters import op12_hamerly
from causeway.llm.fingerprint import op7_canonical_xxhash
from causeway.llm.language import op6_hyperdimensional
from causeway.llm.near_dup import op2_minhash_fss
from causeway.llm.negatives import op11_voronoi_negatives
from causeway.llm.packing import op9_bestfit_bounds
from causeway.llm.pii import op3_pii_checksums
from causeway.llm.quality import op1_quality_llr
from causeway.llm.secrets import op8_secret_tokens
from causeway.llm.sharding import op10_label_propagation
from causeway.llm.toxicity import op5_lexicon_automaton
from causeway.llm.urls import op13_url_markov


OPERATORS = (
    op1_quality_llr, op2_minhash_fss, op3_pii_checksums, op4_bpe_duckdb, op5_lexicon_automaton, op6_hyperdimensional, op7_canonical_xxhash, op8_secret_tokens, op9_bestfit_bounds, op10_label_propagation,
    op11_voronoi_negatives, op12_hamerly, op13_url_markov,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op11_voronoi_negatives": negatives.SQL, "op12_hamerly": clusters.SQL, "op13_url_markov": urls.SQL}
