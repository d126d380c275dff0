"""What the training-data operators share: the shared folder, chunking, packed key counting."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import math
import os
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Raw text bytes of one chunk: what one task holds of the documents at a time.
CHUNK_BYTES = 2 << 20
#: Items that are gathered at a time.
GATHERED = 1 << 17
#: Keys that one bucket of a packed count receives on average.
BUCKET_KEYS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is set and the master is local."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(at)
        return at.rstrip("/")
    if at := spark.sparkContext.getCheckpointDir():
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(at := tempfile.mkdtemp(prefix="shared-"))
    return at


def pinned(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: later steps read the same rows whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application's operators have written to the shared folder; for when all results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, block_bytes: int = 32 << 20) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; columns can then be pruned. block_bytes is what a task's
    writer holds of it."""
    spark = df.sparkSession
    df.write.option("parquet.block.size", str(block_bytes)).parquet(path := work_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than one row in so many.
HOT_SHARE = 1000


def hot_cold_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner", spread: list[str] = ()) -> DataFrame:
    """rows joined with lookup on keys (inner or left), where lookup has each key once, and how many of the rows have it.

    Fewer than HOT_SHARE keys have more than one row in HOT_SHARE, whatever the data: these are broadcast, so that no
    task gets a hot key's rows; the others are joined as usual. Both tables are read twice: pin what is costly. With
    `spread`, columns that tell rows apart, rows are read once: those with a hot key go through the other join, too, but
    by a hash of these columns, and keep what the broadcast gave them.
    """
    total = lookup.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(lookup.filter(is_hot).drop(weight)), lookup.filter(~is_hot).drop(weight)
    if spread:
        values, last = [c for c in cold.columns if c not in keys], keys[-1]
        near = rows.join(F.broadcast(hot.withColumnsRenamed({v: f"_hot_{v}" for v in values}).withColumn("_hit", F.lit(True))), keys, "left")
        near = near.withColumn("_key", F.when(F.col("_hit"), F.xxhash64(*spread).cast(rows.schema[last].dataType)).otherwise(F.col(last)))
        both = near.join(cold.withColumnRenamed(last, "_key").withColumn("_found", F.lit(True)), [*keys[:-1], "_key"], "left")
        both = both if how == "left" else both.filter("_hit or _found")
        return both.select(*rows.columns, *(F.when(F.col("_hit"), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def text_bytes(df: DataFrame, col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, by one aggregation."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()
    return int(n), int(b)


def n_chunks(spark: SparkSession, n_bytes: int) -> int:
    """A few small chunks for each core, more of bounded size as the input grows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / CHUNK_BYTES))


def chunked(df: DataFrame, chunks: int, *keys: str) -> DataFrame:
    """Adds `chunk`, a number from the row's keys alone: a recomputed task makes the same chunk.

    Keys are the id and the text, so that neither copies of one text nor rows without an id share a chunk.
    """
    return df.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), *keys), F.lit(chunks)).cast("int"))


# --- hashes of words and word windows, by numpy over whole batches ---------------------------------------------

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The prime of the Rabin-Karp hashes; text bytes whose words are hashed at a time; windows hashed at a time.
PRIME = (1 << 61) - 1
BLOCK_BYTES, BLOCK_WINDOWS = 1 << 19, 1 << 17


def run_key() -> bytes:
    """A random key. Each run hashes words and windows under its own, so that no input can be made to collide."""
    return os.urandom(16)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def times_plus(a: np.ndarray, b: int, c: np.ndarray) -> np.ndarray:
    """a * b + c modulo PRIME, for values up to PRIME: the product in halves of 31 and 30 bits, as 2^61 is 1."""
    b0, b1 = b & (1 << 31) - 1, b >> 31
    a0, a1 = a & _u((1 << 31) - 1), a >> _u(31)
    mid = a1 * _u(b0) + a0 * _u(b1)
    out = a1 * _u(2 * b1) + (mid >> _u(30)) + ((mid & _u((1 << 30) - 1)) << _u(31))
    out = (out & _u(PRIME)) + (out >> _u(61)) + a0 * _u(b0)
    out = (out & _u(PRIME)) + (out >> _u(61)) + c
    out = (out & _u(PRIME)) + (out >> _u(61))
    return np.where(out >= _u(PRIME), out - _u(PRIME), out)


def _bases(key: bytes, what: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(what, digest_size=32, key=key).digest()
    return tuple(int.from_bytes(d[i : i + 16], "little") % (PRIME - 2) + 2 for i in (0, 16))


def _blocks(text: bytes):
    """A text in blocks of about BLOCK_BYTES; no word is cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        if end < len(text):
            end = m.start() if (m := _GAP.search(text, end)) else len(text)
        yield text[at:end]
        at = end


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a limb, which is below PRIME, and limbs from which a word is digested instead; the masks of shorter limbs.
LIMB, LIMBS = 7, 8
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(LIMB + 1)], np.uint64)


def _values(data: bytes, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin, and two values of each: polynomials over its length and its limbs of LIMB bytes."""
    d = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[d], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=data + b"\0" * 8, strides=(1,))
    out = np.empty((2, len(size)), np.uint64)
    out[:] = size
    live = np.arange(len(size))
    for r in range(LIMBS):
        own = size[live] - LIMB * r
        limb = lanes[starts[live] + LIMB * r] & _MASKS[np.minimum(own, LIMB)]
        for k, base in enumerate(_bases(key, b"words")):
            out[k, live] = times_plus(out[k, live], base, limb)
        live = live[own > LIMB]
        if not len(live):
            break
    for i in np.flatnonzero(size > LIMB * LIMBS):
        out[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16, key=key).digest(), np.uint64) & _u(PRIME)
    return starts, out.T


def word_values(texts: list[bytes], lower: bool, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent values up to PRIME of every word `[^\\x20\\x09-\\x0D]+`, and where each text's words begin (one more at the end).

    Two given words share a value with a chance below LIMBS / 2^60 (or that of a keyed digest, for long ones).
    """
    out, counts = [], np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        data = b"\n".join(held)
        starts, values = _values(data.translate(_LOWER) if lower else data, key)
        out.append(values)
        np.add.at(counts, np.array(owner) + 1, np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))))
        held.clear()
        owner.clear()

    size = 0
    for i, t in enumerate(texts):
        for block in _blocks(t):
            held.append(block)
            owner.append(i)
            size += len(block)
            if size >= BLOCK_BYTES:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64), np.cumsum(counts)


def _rolled(v: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash of every window of v: neighbouring windows are put together until they have the width."""
    h, w = v, 1
    for bit in bin(width)[3:]:
        n = len(v) - 2 * w + 1
        h, w = times_plus(h[:n], pow(base, w, PRIME), h[w : w + n]), 2 * w
        if bit == "1":
            h, w = times_plus(h[:-1], base, v[w:]), w + 1
    return h


def window_hashes(values: np.ndarray, width: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at each word: polynomials over the field of PRIME elements at random points,
    over independent word values. They are independent, and two given windows share one with a chance below width / 2^60."""
    out: list[list[np.ndarray]] = [[], []]
    for i in range(0, max(len(values) - width + 1, 0), BLOCK_WINDOWS):
        for k, base in enumerate(_bases(key, b"windows")):
            out[k].append(mix(_rolled(np.ascontiguousarray(values[i : i + BLOCK_WINDOWS + width - 1, k]), width, base)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)


def release() -> None:
    """Gives memory that a worker has freed back to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())  # other pools keep what they have freed
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gathered(at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The items `at`, one after another, of a table of items of several sizes; GATHERED of the result at a time."""
    to = np.cumsum(sizes[at], dtype=np.int64)
    out = np.empty(to[-1] if len(to) else 0, flat.dtype)
    cuts = np.unique(np.searchsorted(to, np.arange(0, len(out) + GATHERED, GATHERED), side="right"))
    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
        n = sizes[at[a:b]]
        begin, end = to[a] - n[0] if b > a else 0, to[b - 1] if b > a else 0
        out[begin:end] = flat[np.repeat(starts[at[a:b]] - to[a:b] + n, n) + np.arange(begin, end)]
    return out


def parts(sizes: list[int], most: int = 1 << 20):
    """Runs of neighbours with at most so many bytes together; a longer one stands alone."""
    at = total = 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield at, i
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


# --- which keys occur more than once, counted over packed keys --------------------------------------------------


def n_buckets(keys: int) -> int:
    """A power of two; for BUCKET_KEYS keys each at any size of input."""
    return 1 << max(0, math.ceil(math.log2(max(1, keys) / BUCKET_KEYS)), 4)


def by_group(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by group, then key: sorted by key first, then stably by group, which is fast for small numbers."""
    order = np.argsort(key)
    small = group.astype(np.uint16) if len(group) == 0 or group.max() < 1 << 16 else group
    return order[np.argsort(small[order], kind="stable")]


def packed(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) in order: how the keys order them, the first of each, and each row's distinct number."""
    order = by_group(bucket, key)
    b, k = bucket[order], key[order]
    first = np.concatenate(([True], (b[1:] != b[:-1]) | (k[1:] != k[:-1]))) if len(b) else np.zeros(0, bool)
    number = np.empty(len(b), np.int64)
    number[order] = np.cumsum(first) - 1
    return order, first, number


def blobs(chunk: int, bucket: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    """A row for each bucket with the chunk's distinct keys, sorted, and how often it has each (255: or more), as bytes."""
    order, first, number = packed(bucket, key)
    b, k = bucket[order][first], key[order][first]
    n = np.minimum(np.bincount(number, minlength=len(b)), 255).astype(np.uint8)
    edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, int)
    cut = list(zip(edges[:-1], edges[1:], strict=True))
    return pd.DataFrame({"bucket": b[edges[:-1]].astype(np.int32), "chunk": np.full(len(cut), chunk, np.int32), "keys": [k[i:j].tobytes() for i, j in cut], "counts": [n[i:j].tobytes() for i, j in cut]})


BLOBS = "bucket int, chunk int, keys binary, counts binary"
LEVELS = "chunk int, bucket int, levels binary"


def shared_keys(rows: DataFrame, dtype: str) -> DataFrame:
    """For each blob, how often each of its keys occurs in all: a byte a key, 0 for once, then by the count's logarithm.

    A chunk sends each key once, however often it has it, so no key can fill a bucket.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, dtype) for x in pdf["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.frombuffer(b"".join(pdf["counts"]), np.uint8))
        level = np.where(n > 1, np.minimum(np.floor(8 * np.log2(n)), 255), 0).astype(np.uint8)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "levels": [level[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]})

    return rows.groupBy("bucket").applyInPandas(count, LEVELS)


def key_levels(bucket: np.ndarray, key: np.ndarray, levels: pd.DataFrame) -> np.ndarray:
    """The level of each of a chunk's keys: 0 if it occurs once in all, larger the oftener it does."""
    order, first, number = packed(bucket, key)
    if not len(number):
        return np.zeros(0, np.uint8)
    by = dict(zip(levels["bucket"], levels["levels"], strict=True))
    return np.concatenate([np.frombuffer(by[int(x)], np.uint8) for x in np.unique(bucket[order][first])])[number]


# --- places of rows in a global order ---------------------------------------------------------------------------


def numbered(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """df with g, a number for the row's group that grows with the groups' order, pos, its place in the group from 0 by
    `order` (names, or columns for another direction), and m, the group's rows. A null is a group and comes first.

    Rows are sorted by ranges of (group, order), written, and numbered within their task, so a group that holds a third
    of them is the work of many tasks; only what a task holds of each group is counted and joined back.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *group, *order).sortWithinPartitions(*group, *order)
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_task", F.shiftright("_at", 33))
    whole = Window.partitionBy(*(group or [F.lit(0)]))  # without groups, a row for each task
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_task", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select("_task", *group, F.min("_first").over(whole).alias("g"), F.sum("_n").over(whole).alias("m"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = written(runs.withColumnsRenamed({c: f"_{c}_of" for c in group}).withColumnRenamed("_task", "_task_of"), f"{name}-runs")
    same = F.col("_task") == F.col("_task_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    return rows.join(runs, same).select(*df.columns, "g", (F.col("_at") + F.col("_shift")).alias("pos"), "m")
