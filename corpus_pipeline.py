"""A corpus pipeline: each stage works on all that the one before kept; its result is written and read again.

Quality rules drop what they reject, near-dedup keeps one document of each group of near copies (five-word shingles at Jaccard
0.8: SimHash links, then minimum hashes for what their bits cannot reach), decontamination drops documents that hold a benchmark
item, mixing repeats or drops documents toward the sources' target weights, and the last stage encodes what is left as token-id
frames and returns doc_id, start, n_tokens, ids_crc32 from them. The other stages return the columns of their input. Null texts
and doc_ids, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import decontaminate, mixing, quality_rules, simhash, token_output
from inkfold.llm.common import documents, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs)


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: Near-dedup and tokenization have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
