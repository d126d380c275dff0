"""Similarity join of word-shingle sets: a size-aware heavy-light join, reduced to components."""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import BLOBS, blobs, by_group, chunked, key_levels, mix, n_buckets, n_chunks, pinned, parts, release, run_key, shared_keys, text_bytes, window_hashes, word_values, written
from sessionloom.llm.components import connected_components

#: Words of a shingle; similarity in percent from which two sets link.
WORDS, PERCENT = 5, 80
#: Sizes that the boundary is chosen among. A set of this size would send more than 15,000 subsets, which no scan costs.
MOST_LIGHT = 24
#: Prices for the boundary, as measured: a subset that is sent and joined, a list entry that goes through the three scans,
#: and a candidate pair whose two sets are fetched and intersected (about 0.9, 9 and 9 microseconds of 8 cores).
SUBSET_COST, ENTRY_COST, PAIR_COST = 1.0, 10.0, 10.0
#: Entries of one list and size class that are paired in one block; size classes grow by this factor.
BLOCK, CLASS_RATIO = 4096, 1.1


def _shingles(texts: list[bytes], words: int, buckets: int, run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' distinct shingles, by text and hash: which text, bucket, hash. A short text is one shingle."""
    docs, bucket, key = [], [], []
    for i, j in parts([len(t) for t in texts]):
        values, first = word_values(texts[i:j], True, run)
        n = np.diff(first)
        count = np.maximum(n - words + 1, 0)
        doc = np.repeat(np.arange(j - i), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
        h, g = (x[starts] for x in window_hashes(values, words, run))
        for k in range(1, words):  # texts of k words; their hashes are set apart from those of longer shingles
            short = np.flatnonzero(n == k)
            if len(short):
                own = values[(first[:-1][short][:, None] + np.arange(k)).ravel()]
                x, y = (x[::k] ^ np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1) for x in window_hashes(own, k, run))
                doc, h, g = np.concatenate((doc, short)), np.concatenate((h, x)), np.concatenate((g, y))
        order = by_group(doc, h)
        doc, h, g = doc[order], h[order], g[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
        docs.append(doc[new] + i)
        bucket.append((g[new] & np.uint64(buckets - 1)).astype(np.int32))
        key.append(h[new])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs, np.int64), (bucket, np.int32), (key, np.uint64)))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per row of df: id, n (set size), and for sets that can link at all: set_key, shared (hashes, rarest first).

    A set links only if at least percent % of its shingles occur in other documents. The occurrences are counted
    over all documents, on 32 bits of hash beside the bucket: a shingle that is wrongly taken as shared only costs time.
    Hashes are keyed and drawn anew by each run, so no input can be built to collide; that two given shingles share one
    of 61 bits has a chance below words / 2^60, and sets are equal and intersected by these hashes.
    """
    spark, kind, run = df.sparkSession, df.schema[id_col].dataType.simpleString(), run_key()
    _, size = text_bytes(df, text_col)
    chunks, buckets = n_chunks(spark, size), n_buckets(size // 6)
    rows = chunked(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), chunks, "id", "text").repartition("chunk")
    short = lambda h: (h >> np.uint64(32)).astype(np.uint32)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        _, bucket, key = _shingles(list(pdf["text"]), words, buckets, run)
        release()
        return blobs(int(pdf["chunk"].iloc[0]), bucket, short(key))

    def keep(pdf: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        doc, bucket, key = _shingles(list(pdf["text"]), words, buckets, run)
        level = key_levels(bucket, short(key), levels)
        shared = level > 0
        n = np.bincount(doc, minlength=len(pdf))
        m = np.bincount(doc, weights=shared, minlength=len(pdf)).astype(int)
        ends = np.cumsum(n)
        can = (n > 0) & (100 * m >= percent * n)
        keys: list[bytes | None] = [None] * len(pdf)
        sets: list[np.ndarray | None] = [None] * len(pdf)
        for i in np.flatnonzero(can):
            s = slice(ends[i] - n[i], ends[i])
            keys[i] = hashlib.blake2b(key[s].tobytes(), digest_size=16).digest()
            own = shared[s]
            # rarest first, by a count that all documents see alike
            sets[i] = key[s][own][np.lexsort((key[s][own], level[s][own]))].view(np.int64)
        del doc, bucket, key, level, shared
        release()
        return pd.DataFrame({"id": pdf["id"], "n": n.astype(np.int32), "set_key": keys, "shared": sets})

    levels = shared_keys(rows.groupBy("chunk").applyInPandas(send, BLOBS), "<u4")
    return rows.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInPandas(keep, f"id {kind}, n int, set_key binary, shared array<bigint>")


def least_overlap(a, b, percent: int):
    """The smallest intersection at which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _ceil_share(n: str, percent: int) -> Column:
    return F.ceil(F.col(n) * percent / 100).cast("int")


def _prefix(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, own, pos): the inverted lists over each set's prefix; pos is the token's place in the set's order.

    Order a set's unshared shingles first, then the shared from the rarest. Two sets that link have a shingle in common
    among the first n - ceil(percent % of n) + 1 of each; the unshared ones match nothing, so they need no list.
    """
    own = F.col("n") - F.size("shared")
    head = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - _ceil_share("n", percent) + 1, F.lit(0)))
    rows = sets.select("node", "n", own.alias("own"), F.posexplode(head).alias("at", "token"))
    return rows.select("token", "node", "n", "own", (F.col("own") + F.col("at")).alias("pos"))


def _subsets(n: int, percent: int, most: int) -> list[tuple[int, int]]:
    """(partner size, subset size) for each size up to `most` that another set can have that a set of size n links with."""
    sizes = range(-(-percent * n // 100), min(most, 100 * n // percent) + 1)
    return [(s, c) for s in sizes if s and ((c := least_overlap(n, s, percent)) < n or s != n)]  # the whole set only equals itself


def enumerated(n: int, percent: int, most: int = 10**9) -> int:
    """How many subsets a set of size n sends, at most, for partners of sizes up to `most`."""
    return sum(comb(n, c) for _, c in _subsets(n, percent, most) if c <= n)


def _light_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links (u, v) among sets up to the boundary that connect all that link: sets meet at a subset of the needed size.

    A subset is sent for each pair of sizes (low, high) that its size is enough for. All sets at one key link with
    any of them that has the low size, so a star around the smallest such node stands for all their pairs. The links
    are verified, as keys are hashes.
    """
    names = ["low", "high", "key", "node", "n"]

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for node, n, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.asarray(shared.values).view(np.uint64)
                for s, c in _subsets(n, percent, boundary):
                    if c <= len(h):
                        at = np.array(list(combinations(range(len(h)), c)), np.int64)
                        key = mix((mix(h[at]) * (2 * np.arange(c, dtype=np.uint64) + np.uint64(1))).sum(1, dtype=np.uint64))
                        out.append((np.full(len(at), min(n, s), np.int32), np.full(len(at), max(n, s), np.int32), key.view(np.int64), np.full(len(at), node, np.int64), np.full(len(at), n, np.int32)))
                        held += len(at)
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    light = sets.filter(F.col("n") <= boundary).select("node", "n", "shared")
    rows = light.mapInArrow(run, "low int, high int, key long, node long, n int")
    hubs = rows.filter("n = low").groupBy("low", "high", "key").agg(F.min("node").alias("hub"))
    pairs = rows.join(hubs, ["low", "high", "key"]).filter("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    return _verified(pairs, light, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link, by their exact intersection."""
    one = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("su"))
    two = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(one, "u").join(two, "v").filter(both * 100 >= (F.col("nu") + F.col("nv") - both) * percent).select("u", "v")


def _fits(a: str, b: str, percent: int):
    """Whether two sizes can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS_RATIO))).cast("int")


def _cross_pairs(at: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(a, na, b, nb): the pairs of list entries (token, node, n, own, pos, comp) that may link and are in different components.

    Only lists whose members are in several components are scanned; there each member outside the list's main component
    meets all members. The first common token of two sets that link leaves room in both for the overlap they need,
    which bounds the size of an entry's partner: n and pos allow least_overlap(n, m) <= n - pos only up to some m. So
    entries meet by token and class of size, and those without room for any partner make no pair at all. A class
    of more than BLOCK entries is cut into blocks, so that no task pairs a long list alone.
    """
    sizes = at.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").drop("comps")
    room = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent).cast("int") - F.col("n")
    rows = at.join(main, "token").withColumn("low", _ceil_share("n", percent)).withColumn("top", F.least(F.floor(F.col("n") * 100 / percent).cast("int"), room))
    rows = pinned(rows.filter("top >= low"))
    out = rows.filter("comp != main").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("top").alias("ta"), F.col("low").alias("la"), F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("top")))).alias("size"))
    both = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("top").alias("tb"), "main", _size_class(F.col("n")).alias("size"))
    long = both.groupBy("token", "size").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BLOCK).select("token", "size", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    cut = lambda df: df.join(long, ["token", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = cut(out).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    both = cut(both).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).drop("blocks")
    pairs = out.join(both, ["token", "size", "block"]).filter("ca != cb and (cb = main or a < b) and nb between la and ta and na <= tb")
    return pairs.filter(_fits("na", "nb", percent) & (F.greatest("na", "nb") > boundary)).select("a", "na", "b", "nb")


def _heavy_links(lists: DataFrame, sets: DataFrame, boundary: int, links: DataFrame, percent: int) -> DataFrame:
    """More links, so that all sets of which one is above the boundary are connected with what they link with.

    Scans the inverted lists. First each list links its members with one hub, that with the fewest shingles of its
    own (an original has fewer than its edited copies), then with the best member outside the hub's component. Then
    lists whose members are still in several components are scanned in full, across components. No pair inside a
    component is made there.
    """
    rank = F.struct("own", "node", "n", "comp")
    for step in ("hub", "second", "full"):
        labels = connected_components(links)
        at = lists.join(labels, "node", "left").select("token", "node", "n", "own", "pos", F.coalesce("comp", "node").alias("comp"))
        at = pinned(at)
        if step == "full":
            pairs = _cross_pairs(at, boundary, percent)
        else:
            stats = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(rank).alias("hub")).filter("lo != hi")
            if step == "second":
                others = at.join(stats.select("token", F.col("hub.comp").alias("first")), "token").filter("comp != first")
                stats = others.groupBy("token").agg(F.min(rank).alias("hub"))
            pairs = at.join(stats.select("token", F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.comp").alias("cb")), "token")
            pairs = pairs.filter("comp != cb").select(F.col("node").alias("a"), F.col("n").alias("na"), "b", "nb")
        pairs = pairs.filter(_fits("na", "nb", percent) & (F.greatest("na", "nb") > boundary))
        pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        pairs = pairs.distinct()
        links = pinned(links.unionByName(_verified(pairs, sets, percent)))
    return links


def _cheapest(counts: dict[int, int], entries: dict[int, int], pairs: dict[int, int], percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by the number of sets of each size, their
    list entries, and the candidate pairs that these bring to the first two scans.

    With boundary x the sets up to x send subsets for partners up to x; lists keep the sets that may link with one
    above x.
    """
    def cost(x: int) -> float:
        light = sum(SUBSET_COST * k * enumerated(n, percent, x) for n, k in counts.items() if n <= x)
        return light + sum(ENTRY_COST * entries.get(n, 0) + PAIR_COST * pairs.get(n, 0) for n in counts if n * 100 >= (x + 1) * percent)

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _boundary(sets: DataFrame, percent: int) -> int:
    """The boundary, by counts over all sets of up to MOST_LIGHT shingles; larger ones are in the lists whatever it is."""
    lists = _prefix(sets, percent)
    small = lists.filter(F.col("n") <= MOST_LIGHT)
    long = lists.join(small.select("token").distinct(), "token", "left_semi").groupBy("token").agg((F.least(F.count(F.lit(1)), F.lit(3)) - 1).alias("k"))
    by = small.join(long, "token").groupBy("n").agg(F.count(F.lit(1)).alias("entries"), F.sum("k").alias("pairs")).collect()
    counts = {r["n"]: r["count"] for r in sets.filter(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    return _cheapest(counts, {r["n"]: r["entries"] for r in by}, {r["n"]: r["pairs"] for r in by}, percent)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    A document's set is its distinct `words`-word shingles after lower-casing A-Z; with fewer words the sequence
    is one shingle; null or blank texts have none and link with nothing. Sets link when
    100 * intersection >= percent * union. Equal sets are one node from the start. Rows that repeat an id keep
    their own set each; null ids count only where a component has no other.

    Sets up to a boundary meet at enumerated subsets, pairs with a larger one by scanning inverted lists. The boundary
    is the size, of 0 to MOST_LIGHT, at which both together are cheapest.
    """
    spark: SparkSession = df.sparkSession
    rows = written(shingle_sets(df, id_col, text_col, words, percent), "sets")
    able = rows.filter(F.col("set_key").isNotNull())
    classes = able.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("shared").alias("shared"))
    sets = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    boundary = _boundary(sets, percent)
    links = pinned(_light_links(sets, boundary, percent))
    lists = written(_prefix(sets.filter(F.col("n") * 100 >= (boundary + 1) * percent), percent), "lists")
    links = _heavy_links(lists, sets, boundary, links, percent)
    labels = connected_components(links)
    light = sets.select("set_key", "node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = light.groupBy("comp").agg(F.min("rep").alias("component"))
    names = light.join(least, "comp").select("set_key", "component")
    return rows.select("id", "n", "set_key").join(names, "set_key", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT r, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
s AS (SELECT DISTINCT r, x FROM (SELECT r, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM word) WHERE i <= greatest(n - 4, 1)),
sets AS (SELECT r, list(x ORDER BY x) AS shingles FROM s GROUP BY r),
c AS (SELECT min(r) AS k, len(shingles) AS n, min(doc_id) AS least, list(r) AS members FROM sets JOIN d USING (r) GROUP BY shingles),
e AS (SELECT k, n, x FROM c JOIN s ON s.r = c.k),
link AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.k, b.k HAVING 180 * count(*) >= 80 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT k, k AS at FROM c UNION SELECT reach.k, link.b FROM reach JOIN link ON link.a = reach.at),
comp AS (SELECT reach.k, min(o.least) AS component_id FROM reach JOIN c o ON o.k = reach.at GROUP BY reach.k),
per AS (SELECT r, n, component_id FROM (SELECT k, n, unnest(members) AS r FROM c) JOIN comp USING (k))
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN per USING (r)
"""
