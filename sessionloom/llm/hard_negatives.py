"""Hard-negative mining by norm-bucketed search: candidates sorted by norm, buckets pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import numbered, release, written

#: Bytes of a bucket's and of a block of anchors' vectors; anchors scored at a time; a wave takes so many times the buckets
#: of all before it.
BUCKET_BYTES, ANCHOR_BYTES, SCORED, GROWTH = 4 << 20, 1 << 20, 128, 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor long, slot int, key long, id long, score long"


def quantized(x: Column, scale: int) -> Column:
    """Each component as floor(scale * x), x as double; beyond a long, its end."""
    return F.transform(x.cast("array<double>"), lambda c: F.floor(c * scale))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of the rows of a and b, exact; beyond a long, its end."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, missing last components as 0."""
    n = np.asarray(pc.list_value_length(col), np.int64)
    out = np.zeros((len(col), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = np.asarray(col.flatten(), np.int64)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the first k are, by falling score and then by id."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((ids[near], ~score[near]))[:k]]
    return np.lexsort((ids, ~score))


def _matcher(same: bool, k: int):
    """For a bucket and a block of anchors: the first k candidates of each of an anchor's windows, as far as they come
    before the kth that it has. ~score, not -score, as that has no overflow."""

    def match(table: pa.Table) -> pa.Table:
        pick = lambda name: pa.chunked_array(table.column(name).chunks).drop_null().combine_chunks().flatten()
        anchors, cands = pick("anchors"), pick("cands")
        out: list[list] = [[], [], [], [], []]
        dims = max(pc.max(pc.list_value_length(x.field("v"))).as_py() or 0 for x in (anchors, cands))
        a, c = _matrix(anchors.field("v"), dims), _matrix(cands.field("v"), dims)
        a_key, c_key, ids = (np.asarray(x, np.int64) for x in (anchors.field("key"), cands.field("key"), cands.field("id")))
        a_norm, top = np.asarray(anchors.field("norm")), np.asarray(cands.field("norm")).max()
        kinds = np.unique(np.array(anchors.field("label").to_pylist() + cands.field("label").to_pylist()), return_inverse=True)[1]
        a_kind, c_kind = kinds[: len(a)], kinds[len(a) :]
        windows = anchors.field("windows").to_pylist()
        for kind in np.unique(a_kind):
            own = np.flatnonzero(a_kind == kind)
            there = np.flatnonzero((c_kind == kind) == same)
            for at in range(0, len(own) if len(there) else 0, SCORED):
                rows = own[at : at + SCORED]
                for r, s in zip(rows, products(a[rows], c[there]), strict=True):
                    for w in windows[r]:
                        floor = w["low"] if w["kth"] is None else max(w["low"], w["kth"])
                        if floor > a_norm[r] * top * (1 + 1e-9) + 1:  # by Cauchy-Schwarz
                            continue
                        hit = np.flatnonzero((s >= floor) & (s <= w["high"]))
                        hit = hit[c_key[there[hit]] != a_key[r]]
                        hit = hit[_best(s[hit], ids[there[hit]], k)]
                        if w["kth"] is not None:
                            hit = hit[(s[hit] > w["kth"]) | (ids[there[hit]] < w["kth_id"])]
                        for to, x in zip(out, (np.full(len(hit), a_key[r]), np.full(len(hit), w["slot"]), c_key[there[hit]], ids[there[hit]], s[hit]), strict=True):
                            to.append(x)
        cols = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        release()
        return pa.Table.from_arrays(cols, names=["anchor", "slot", "key", "id", "score"])

    return match


def _searched(anchors: DataFrame, buckets: DataFrame, n_buckets: int, block: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, key, id, score): the first k candidates of every window of anchors (key, label, norm, v, windows).

    Buckets are numbered by falling norm and searched in a few waves, each GROWTH times all before. Before a wave the
    anchors are sorted by the least norm that a candidate must have for one of their windows, by its lower limit or the
    kth score found so far, and cut into blocks; a block meets the buckets of the wave that reach its least such norm.
    """
    spark = anchors.sparkSession
    found, begin = spark.createDataFrame([], FOUND), 0
    while begin < n_buckets:
        end = min(n_buckets, max(1, begin * (GROWTH + 1)))
        kth = found.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", F.bitwise_not("id").alias("not_id"))).alias("worst")).filter(F.col("n") >= k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("worst"))  # slots are few
        now = anchors.join(kth.withColumnRenamed("anchor", "key"), "key", "left")
        at = lambda w: F.try_element_at("worst", w["slot"])
        now = now.withColumn("windows", F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), at(w)["score"].alias("kth"), F.bitwise_not(at(w)["not_id"]).alias("kth_id")))).drop("worst")
        floor = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["kth"]))).cast("double")
        need = F.when(floor <= 0, F.lit(0.0)).when(F.col("norm") == 0, F.lit(float("inf"))).otherwise((floor - 1) / F.col("norm") * (1 - 1e-9))
        blocks = numbered(now.withColumn("need", need), [], ["need", "key"], "anchors").withColumn("block", F.expr(f"pos div {block}"))
        blocks = written(blocks.groupBy("block").agg(F.min("need").alias("need"), F.collect_list(F.struct("key", "label", "norm", "v", "windows")).alias("anchors")), "anchor-blocks")
        wave = buckets.filter((F.col("bucket") >= begin) & (F.col("bucket") < end))
        pairs = blocks.select("block", "need", F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(end - 1).cast("long"))).alias("bucket"))
        pairs = written(pairs.join(wave.select("bucket", "norm"), "bucket").filter(F.col("norm") >= F.col("need")).select("block", "bucket"), "pairs")
        sent = pairs.join(wave, "bucket").select("block", "bucket", "cands", F.lit(None).cast(blocks.schema["anchors"].dataType).alias("anchors"))
        sent = sent.unionByName(pairs.join(blocks, "block").select("block", "bucket", F.lit(None).cast(buckets.schema["cands"].dataType).alias("cands"), "anchors"))
        new = sent.groupBy("block", "bucket").applyInArrow(_matcher(same, k), FOUND)
        first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "key")
        found = written(found.unionByName(new).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank"), "found")
        begin = end
    return found


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, bucket_bytes: int = BUCKET_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by whole scores.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Components become
    floor(scale * x); a score is the integer inner product, missing components being 0, and scores or components beyond a
    long are its ends. Anchors are the rows for which the column `anchors`, made from df's, is true. An anchor's positives
    are its first `positives` other rows of its label, by falling score, then by id; a pair's negatives the first
    `negatives` rows of other labels whose score is at most the positive's and at least least_percent % of it (none, if it
    is negative). Rows that share an id are rows of their own; among equal ids and scores any one is taken, which gives
    the same result. An empty table, or one without anchors, gives an empty result.

    The stated anchors meet all rows, in blocks: candidates are sorted by norm and bucketed; buckets whose norm cannot
    reach a window's lower limit or its running kth score are never sent. Vectors of one norm leave nothing to prune.
    A group of equal vectors ties, and sends k rows a bucket at most. Nothing is broadcast or brought to the driver but
    counts.
    """
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists(F.coalesce("vec", F.array()), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).filter(ok)
    rows = rows.select("id", "label", "is_anchor", quantized(F.col("vec"), scale).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    rows = numbered(rows, [], [F.desc("norm"), "id"], "by-norm").withColumnRenamed("pos", "key")
    dims, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    wide = 8 * max(dims or 0, 1)
    per, block = max(64, bucket_bytes // wide), max(16, anchor_bytes // wide)
    buckets = written(rows.groupBy(F.expr(f"key div {per}").alias("bucket")).agg(F.max("norm").alias("norm"), F.collect_list(F.struct("key", "id", "label", "norm", "v")).alias("cands")), "buckets")
    own = written(rows.filter("is_anchor").select("key", F.col("id").alias("own_id"), "label", "norm", "v"), "own")
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    every = own.drop("own_id").withColumn("windows", F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    good = _searched(every, buckets, -(-n // per), block, True, positives).filter("score >= 0")
    slot = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "key"))
    good = written(good.select("anchor", slot.alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.expr(f"(cast(positive_score as decimal(20, 0)) * {least_percent} + 99) div 100")
    windows = good.groupBy(F.col("anchor").alias("key")).agg(F.collect_list(window(F.col("slot"), low, F.col("positive_score"))).alias("windows"))
    bad = _searched(own.drop("own_id").join(windows, "key"), buckets, -(-n // per), block, False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "key"))
    bad = bad.select("anchor", "slot", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = bad.join(good, ["anchor", "slot"]).join(own.select(F.col("key").alias("anchor"), F.col("own_id").alias("anchor_id")), "anchor")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.no, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CASE WHEN least(len(a.v), len(b.v)) = 0 THEN 0 ELSE CAST(list_inner_product(a.v[1:least(len(a.v), len(b.v))], b.v[1:least(len(a.v), len(b.v))]) AS BIGINT) END AS score
  FROM v a JOIN v b ON a.no <> b.no WHERE a.vec_id % 100 = 0),
p AS (SELECT no, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY no ORDER BY score DESC, id) AS slot FROM s WHERE same QUALIFY slot <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY no, slot ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (no) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
