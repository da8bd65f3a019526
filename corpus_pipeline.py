"""The training-data pipeline: five stages, each written as Parquet and read again as the next one's input.

Rejected documents go, one document of each near-duplicate group stays, secrets are masked, sources are
mixed to their target weights (a document that the mix takes twice is two rows, one that it does not take
is gone, and a source's last copy may end early) and the mix is encoded. No stage drops rows for another
reason; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.llm import mixing, quality, queries, secret_scan, simhash
from fundlens.llm.shared import documents, fresh, labels
from fundlens.session import materialize, ship_package

ORACLE_SQL = None  # trained models, fingerprints and subwords: tests compare with a brute-force version


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    ship_package(spark)
    names = [fresh(f"quality_{k}", docs.columns) for k in range(8)]
    judged = quality.judged(docs, "text", quality.fit_quality(docs, labels(spark, sf_dir)), names)
    return judged.filter(F.col(names[-1])).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within two bits of a fingerprint."""
    ship_package(spark)
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return _recounted(secret_scan.redacted(docs, "source"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    ship_package(spark)
    return _recounted(mixing.shards(mixing.mixed(docs)))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row; ids are packed 32-bit integers."""
    ship_package(spark)
    return queries.bpe_digest(docs, "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else materialize(docs)
    return docs


def llm_queries() -> dict:
    return {"pipeline": run}


def llm_oracles() -> dict[str, str]:
    return {}
