"""Exact deduplication by deterministic block naming, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import hot_cold_join, pinned

#: Bytes of a block: most texts are one block, long ones go through log2(blocks) rounds of pair naming.
BLOCK_BYTES = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; the fast path holds where every character is one byte."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def _named(keys: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct keys with an integer name each (the number of the partition and the rank in its sorted keys), and k,
    how often each occurs.

    Repeats go on the map side, so a key that fills a third of the rows is one row of each task. Callers pin the result.
    """
    return keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("k")).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id() + 1)


def block_identity(df: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of df but the text, with row_id, text_sha256, n_blocks and name.

    Two rows have equal (n_blocks, name) exactly when their texts are equal after lower-casing A-Z. A null text
    counts as empty. Round 0 names the fixed-size blocks of all texts: distinct blocks are sorted and numbered.
    Each further round names the pairs of neighbouring names, until every text has one.
    The occurrences fetch their block's name by a 128-bit fingerprint, so whole blocks are shuffled once; names that
    many rows have are fetched by a broadcast of the few such names. Should two
    different blocks share a fingerprint, it has two names; then round 0 is done again with other seeds.
    Row ids and names are pinned in the shared folder, so every round sees the same ones.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(*[c for c in df.columns if c != text_col], norm.alias("norm")).withColumn("bin", F.col("norm").cast("binary"))
    rows = rows.withColumn("n_blocks", F.greatest(F.ceil(F.octet_length("norm") / block_bytes), F.lit(1)).cast("int"))
    cut = f"transform(sequence(0, n_blocks - 1), i -> substring(bin, i * {block_bytes} + 1, {block_bytes}))"
    for seed in range(100):
        prints = [F.xxhash64(F.lit(seed), F.lit(i), F.col("block")).alias(f"f{i}") for i in (1, 2)]
        names = pinned(_named(rows.select(F.explode(F.expr(cut)).alias("block")), ["block"]).select(*prints, "name", "k"))
        if names.groupBy("f1", "f2").count().filter("count > 1").isEmpty():
            break
    both = f"transform({cut}, b -> named_struct('f1', xxhash64({seed}, 1, b), 'f2', xxhash64({seed}, 2, b)))"
    light = pinned(rows.select(*[c for c in df.columns if c != text_col], F.monotonically_increasing_id().alias("row_id"), F.sha2("norm", 256).alias("text_sha256"), "n_blocks", F.expr(both).alias("prints")))
    level = light.select("row_id", "n_blocks", F.posexplode("prints").alias("pos", "p")).select("row_id", "n_blocks", "pos", "p.f1", "p.f2")
    level = pinned(hot_cold_join(level, names, ["f1", "f2"], "k", spread=["row_id", "pos"]).select("row_id", "n_blocks", "pos", "name"))
    most, width, done = level.agg(F.max("n_blocks")).first()[0] or 1, 1, []
    while width < most:
        done.append(level.filter(F.col("n_blocks") <= width))
        pair = level.filter(F.col("n_blocks") > width).groupBy("row_id", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        # the second of a lone last name is 0, which no name is
        halves = [F.sum(F.when(F.col("pos") % 2 == k, F.col("name")).otherwise(0)).alias(c) for k, c in ((0, "a"), (1, "b"))]
        pairs = pinned(pair.agg(*halves))
        level = pinned(hot_cold_join(pairs, pinned(_named(pairs, ["a", "b"])), ["a", "b"], "k", spread=["row_id", "pos"]).select("row_id", "n_blocks", "pos", "name"))
        width *= 2
    final = level.filter(F.col("n_blocks") <= width)
    for x in done:
        final = final.unionByName(x)
    return light.drop("prints", "n_blocks").join(final.select("row_id", "n_blocks", "name"), "row_id")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (a null id is the smallest; rows that tie on it all stay).
    Null texts count as empty, so they equal each other and empty texts. An empty table gives an empty result.
    """
    named = block_identity(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", block_bytes)
    groups = pinned(named.groupBy("n_blocks", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("k", F.col("group_size")))
    joined = hot_cold_join(named, groups, ["n_blocks", "name"], "k", spread=["row_id"])
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
