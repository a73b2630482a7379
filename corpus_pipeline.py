"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before kept, and its decisions take effect: rejected
documents go, of equal texts and of near-duplicates one stays, contaminated documents go, and
the last stage encodes what is left. Between stages the documents are a table in the shared
folder, so a lost executor costs no more than the stage that it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe_codec, decontaminate, exact_dedup, quality, simhash_neardup
from tidemill.llm.common import materialize, table

STAGES = [
    ("quality classifier", quality.keep_good),
    ("exact dedup", exact_dedup.keep_distinct),
    ("simhash near-dedup", simhash_neardup.keep_one),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("bpe encoding and decoding", bpe_codec.encode_stage),
]

#: No SQL: the first, third and last stage can't be expressed in it. Tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
