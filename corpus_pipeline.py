"""A corpus pipeline: language id, exact dedup, near-duplicate join, decontamination, byte-level BPE.

Each filtering stage but the first drops by id what its operator rejects: rows that share an id fall together if one of
them is rejected, and rows with a null id stay. Without documents, or with none that a stage keeps, the result is
empty. A stage sees what its predecessor kept, read again from Parquet; other columns, whatever their names, go along.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.bpe import encode, token_digests
from sessionloom.llm.common import written
from sessionloom.llm.decontaminate import contained_items
from sessionloom.llm.exact_dedup import exact_dedup
from sessionloom.llm.jaccard_join import jaccard_components
from sessionloom.llm.langid import identify, learned


#: Bytes of the batches that Spark hands to Python workers; its default holds 10,000 whole documents.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """While this lasts, what a task and its worker hold of a batch is bounded by bytes; then the session is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the dropped ids. They are written first, so that the join is planned by their true size."""
    return docs.join(written(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language: documents without a letter go."""
    others = [c for c in docs.columns if c != "doc_id"]
    with _small_batches(spark):
        return written(identify(docs, learned(docs), keep=others).filter("lang_pred != 'und'").select(*docs.columns), "spoken")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the copy with the largest id of equal texts."""
    return _without(docs, exact_dedup(docs).filter("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    with _small_batches(spark):
        return _without(docs, jaccard_components(docs).filter("doc_id != component_id"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return _without(docs, contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text. The ids are written in between, so that no task
    holds two Python workers."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with _small_batches(spark):
        return written(token_digests(written(encode(docs, path, public_tokenizers.PATTERN), "ids", 8 << 20), path), "digests")


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontamination", clean), ("byte_bpe", tokens)]
#: Languages and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
