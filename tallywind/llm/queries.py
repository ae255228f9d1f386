"""Queries of this subpackage and their oracle statements, by name."""

from __future__ import annotations

from functools import partial

from . import (
    decontaminate, exact_dedup, jaccard_join, lm_trie, pii, piece_codec, quality_knn, source_audit, sql, suffix_dedup, token_counts, token_output,
    toxic_segments, whitening,
)
from .shipping import ship

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _over_documents(operator, *others):
    """The query that applies ``operator`` to ``documents`` and to the other tables."""
    return _over(operator, "documents", *others)


def _over(operator, *tables):
    def build(spark, sf_dir):
        ship(spark)
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return operator(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables))

    return build


QUERIES = {
    "op1_token_shards": _over_documents(token_output.token_digests),
    "op2_suffix_dedup": _over_documents(suffix_dedup.removed_substrings),
    "op3_lm_trie": _over_documents(partial(lm_trie.lm_scores, order=lm_trie.ORDER)),
    "op4_piece_codec": _over_documents(piece_codec.codec_digests),
    "op5_quality_knn": _over_documents(quality_knn.quality_scores, "labels"),
    "op6_decontamination": _over_documents(decontaminate.leaks, "benchmark"),
    "op7_toxic_segments": _over_documents(toxic_segments.toxicity, "labels"),
    "op8_pii": _over_documents(pii.pii_report),
    "op9_jaccard_join": _over_documents(jaccard_join.near_copies),
    "op10_exact_dedup": _over_documents(exact_dedup.exact_groups),
    "op11_token_counts": _over_documents(token_counts.token_counts),
    "op12_source_audit": _over_documents(source_audit.source_audit),
    "op13_whitening": _over(whitening.whitened, "embeddings"),
}
ORACLES = {"op10_exact_dedup": sql.EXACT_DEDUP, "op12_source_audit": sql.SOURCE_AUDIT}
