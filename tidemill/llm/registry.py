"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from tidemill.llm import bpe_codec, centroid_clusters, decontaminate, exact_dedup, exact_topk, filter_audit, license_scan, pii, quality, simhash_neardup, substring_dedup, url_filter, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_pii_surrogates": pii.op2_pii_surrogates,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_simhash_neardup": simhash_neardup.op7_simhash_neardup,
        "op8_bpe_codec": bpe_codec.op8_bpe_codec,
        "op9_quality": quality.op9_quality,
        "op10_warc": warc.op10_warc,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_exact_topk": exact_topk.op12_exact_topk,
        "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_exact_topk": exact_topk.OP12_SQL,
        "op13_centroid_clusters": centroid_clusters.OP13_SQL,
    }
