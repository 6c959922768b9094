"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .audit import op12_filter_audit
from .bpe import op2_bpe_merge_replay
from .brown import op5_brown_classes
from .digests import op3_quartile_digest
from .merkle import op11_merkle_manifest
from .mixing import op6_pivotal_mixing
from .oracles import oracle_sql
from .quality import op8_line_quality
from .secrets import op4_markov_secrets
from .sharding import op10_hilbert_shards
from .simhash import op1_simhash_vptree
from .substrings import op7_count_min_substrings
from .tokenfiles import op13_rans_files
from .urls import op9_path_templates

__all__ = ["ALL", "oracle_sql", "queries"]

ALL = (
    op1_simhash_vptree, op2_bpe_merge_replay, op3_quartile_digest, op4_markov_secrets, op5_brown_classes,
    op6_pivotal_mixing, op7_count_min_substrings, op8_line_quality, op9_path_templates, op10_hilbert_shards,
    op11_merkle_manifest, op12_filter_audit, op13_rans_files,
)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in ALL} | {"pipeline": corpus_pipeline.run}
