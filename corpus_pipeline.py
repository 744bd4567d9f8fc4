"""Five stages over documents, each written as Parquet and read again as the next one's input.

Labels teach the first two stages; rows that they reject go. Then one document of each group of near
duplicates (five words, 0.8) stays, documents with benchmark passages go, and the rest is encoded.

Rows: a null or empty text has no words and fails the quality rules; of repeated rows that pass both filters one stays, of
rows with one doc_id and several texts each is judged by its own; a null doc_id is kept like any other. Other columns
are kept up to the last stage, whatever their names. An empty table gives an empty one, as does one of which nothing is kept;
without labels nothing is toxic and the quality rules are the base rule alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvella.llm import decision_list, decontaminate, jaccard_join, prefix_bpe, toxicity
from corvella.llm.common import discard, stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_rules", decision_list.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("byte_level_bpe", prefix_bpe.stage),
]
#: Learned and iterative stages have no SQL form; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
