"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from array import array
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import gathered, hot_cold_join, parts, pinned, release, text_bytes

#: Text bytes of a chunk, whose distinct words are sent once; text bytes for each bucket of words; characters from which
#: a text's words are numbered one by one instead of listed.
CHUNK_TEXT, BUCKET_TEXT, LONG_TEXT = 4 << 20, 8 << 20, 1 << 20
#: A token-byte table of so many bytes is broadcast to the tasks; a larger one is joined by a shuffle.
TABLE_BYTES = 64 << 20
#: The pattern that the fast path below is written for (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters outside the range where both engines' classes are known to agree, or on which they differ.
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧‰-⁞]")
_ODD_ASCII = re.compile("[\x1c-\x1f]")


def splitter(pattern: str):
    """A function from a text to an iterable of its pre-tokens, as the rank file's library cuts them."""
    import regex

    # that library's \s is the Unicode property, without the four separators U+001C to U+001F
    whole = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def cut(text: str):
        fast = pattern == PATTERN and not (_ODD_ASCII if text.isascii() else _ODD).search(text)
        if len(text) > LONG_TEXT or not fast:
            return (m.group() for m in (_FAST if fast else whole).finditer(text))
        return _FAST.findall(text)

    return cut


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their lowest bytes first, then the next ones: small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(sizes: np.ndarray, body: bytes) -> bytes:
    """Items as their sizes and their bytes one after another, compressed."""
    import zstandard

    return struct.pack("<I", len(sizes)) + zstandard.ZstdCompressor(level=6).compress(_planes(sizes) + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    n, data = struct.unpack_from("<I", blob)[0], zstandard.ZstdDecompressor().decompress(blob[4:])
    return _from_planes(data[: 4 * n]), data[4 * n :]


def _number(texts: list[str], cut) -> tuple[dict[str, int], list[np.ndarray]]:
    """The distinct pre-tokens of the texts, numbered as they come, and the numbers at every text's positions."""
    number: dict[str, int] = {}
    out = []
    for t in texts:
        words = cut(t)
        if isinstance(words, list):
            for w in dict.fromkeys(words):
                number.setdefault(w, len(number))
            out.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        else:
            out.append(np.frombuffer(array("I", (number.setdefault(w, len(number)) for w in words)), np.uint32))
    return number, out


def encode(df: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, ids (array of token ids, in text order). Null and empty texts give no ids.

    Each task cuts its texts into chunks of about CHUNK_TEXT bytes and explodes them into pre-tokens with positions,
    in packed form: the chunk's distinct pre-tokens go once to the bucket of their hash, and the positions are kept as
    an array of pre-token numbers in text order, the most frequent ones the smallest. A bucket encodes each distinct
    pre-token of all chunks once; the ids are joined back to the chunk's positions by pre-token number, and the texts
    reassembled by position. A pre-token that fills a third of the corpus is sent once a chunk, and nothing grows with
    its count. A chunk is named by a digest of its pre-tokens, so a chunk that a lost executor made and that comes out
    in another way finds no ids and is an error, never another's. Whole texts of any length (a text longer than
    CHUNK_TEXT is a chunk of its own); repeated rows give repeated results.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    _, size = text_bytes(df, text_col)
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_TEXT))

    def explode(batches):
        cut = splitter(pattern)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in parts(lengths, CHUNK_TEXT):
                number, at = _number([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], cut)
                words, count, every = [w.encode() for w in number], np.array([len(x) for x in at]), np.concatenate(at)
                frequent = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[frequent] = np.arange(len(words))
                texts = _pack(count, _planes(rank[every]))
                of = [zlib.crc32(w) % buckets for w in words]
                order = sorted(range(len(words)), key=lambda k: (of[k], words[k]))
                ids = batch.column(0).slice(i, j - i)
                name = hashlib.blake2b(repr(ids.to_pylist()).encode(), digest_size=8)
                rows, at = [], 0
                for b, group in groupby(order, key=of.__getitem__):
                    own = [words[k] for k in group]
                    rows.append((None, b, None, None, _pack(np.array([len(w) for w in own]), b"".join(own))))
                    name.update(rows[-1][4])
                place = np.empty(len(words), np.int64)  # where each number's word is in the order in which they are sent
                place[rank[order]] = np.arange(len(words))
                rows.append((ids.to_pylist(), -1, place.astype("<u4" if len(words) > 1 << 16 else "<u2").tobytes(), texts, None))
                cols = list(zip(*rows, strict=True))
                chunk = int.from_bytes(name.digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array(cols[0], pa.list_(batch.schema.field(0).type)), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["chunk", "ids", "bucket", "place", "texts", "words"])
        release()

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[pdf["bucket"] >= 0, ["bucket", "chunk", "words"]].drop_duplicates("bucket")

    def encode_words(pdf: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for blob in pdf["words"]:
            sizes, body = _unpack(blob)
            ends = np.cumsum(sizes).tolist()
            words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            for w in words:
                if w not in known:
                    known[w] = own.encode_ordinary(w.decode())
            got = [known[w] for w in words]
            out.append(_pack(np.array([len(x) for x in got]), _planes(np.fromiter(chain.from_iterable(got), np.uint32))))
        del known, own
        release()
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "coded": out})

    def assemble(rows: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        got = [(s, _from_planes(x)) for s, x in map(_unpack, coded.sort_values("bucket")["coded"])]
        sizes = np.concatenate([s for s, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        flat = np.concatenate([x for _, x in got]).astype(np.int32) if got else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        names, out = [], []
        texts = rows[rows["bucket"] < 0]
        for ids, place, text in zip(texts["ids"], texts["place"], texts["texts"], strict=True):
            where = np.frombuffer(place, "<u4" if len(sizes) > 1 << 16 else "<u2")
            if len(where) != len(sizes):
                raise ValueError("a chunk was made anew in another way: pin the input")
            count, body = _unpack(text)
            at, ends = _from_planes(body), np.cumsum(count, dtype=np.int64)
            for a, b in zip(ends - count, ends, strict=True):
                out.append(gathered(where[at[a:b]], sizes, starts, flat))
            names += list(ids)
        release()
        return pd.DataFrame({"id": pd.Series(names, dtype=object), "ids": out})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(explode, f"chunk long, ids array<{kind}>, bucket int, place binary, texts binary, words binary").repartition("chunk")
    words = rows.groupBy("chunk").applyInPandas(send, "bucket int, chunk long, words binary")
    coded = words.groupBy("bucket").applyInPandas(encode_words, "chunk long, bucket int, coded binary")
    return rows.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInPandas(assemble, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _table(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of numbers: their sizes (-1 for a number that has none), where they start, and the bytes."""
    size = np.full(max((i for i, _ in rows), default=-1) + 1, -1)
    size[[i for i, _ in rows]] = [len(b) for _, b in rows]
    return size, np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.frombuffer(b"".join(b for _, b in sorted(rows)), np.uint8)


def _joined(col: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the numbers of each row stand for in the table, one after another, and where each row begins."""
    size, start, flat = table
    own = np.asarray(col.flatten())
    if len(own) and (own.min() < 0 or own.max() >= len(size) or size[own].min() < 0):
        raise ValueError("an id is not in the table")
    ends = np.cumsum(np.array(pc.fill_null(pc.list_value_length(col), 0), np.int64))
    return gathered(own, size, start, flat), np.concatenate(([0], np.cumsum(size[own])))[np.concatenate(([0], ends))]


def _slices(batches, ids_col: str):
    """Runs of neighbouring rows with a bounded number of ids, unless one row has more."""
    for batch in batches:
        for i, j in parts(pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_pylist(), 1 << 17):
            yield batch.slice(i, j - i)
    release()


def _small(ranks: dict[bytes, int], table_bytes: int) -> bool:
    return sum(len(b) + 8 for b in ranks) <= table_bytes


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """df with `decoded`, the bytes of its ids, by a join with the token-byte table.

    The table is measured: up to table_bytes it is broadcast and each task joins its rows' positions with it at once;
    a larger one is joined with the exploded positions by a shuffle, hot tokens apart, and the bytes are put together
    by position. Null ids give null; an id that the table lacks is an error.
    """
    spark, ranks = df.sparkSession, read_ranks(ranks_path)
    table = [(i, b) for b, i in ranks.items()]
    if not _small(ranks, table_bytes):
        return _decode_shuffled(df, spark.createDataFrame(table, "token int, bytes binary"), ids_col)
    shared = spark.sparkContext.broadcast(_table(table))

    def run(batches):
        for rows in _slices(batches, ids_col):
            data, edges = _joined(rows.column(ids_col), shared.value)
            done = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns, pc.if_else(rows.column(ids_col).is_null(), pa.scalar(None, pa.binary()), done)], names=[*rows.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, decoded binary")


def token_digests(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes); null for null ids.

    As decode, but neither ids nor bytes leave a task: a slice of rows is decoded, digested and let go.
    """
    spark, ranks = df.sparkSession, read_ranks(ranks_path)
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    names = ("id", "n_tokens", "ids_sha256", "decoded_sha256")
    if not _small(ranks, table_bytes):
        done = decode(rows, ranks_path, "ids", table_bytes)
        ids = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
        return done.select("id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast((_table([(i, b) for b, i in ranks.items()]), _table([(i, b"%d," % i) for i in ranks.values()])))

    def digests(data: np.ndarray, edges: np.ndarray, less: int) -> list[str]:
        at = memoryview(data)
        return [hashlib.sha256(at[a : max(a, b - less)]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def run(batches):
        for rows in _slices(batches, "ids"):
            col = rows.column("ids")
            cols = [pa.array(digests(*_joined(col, table), less), pa.string()) for table, less in zip(shared.value, (0, 1), strict=True)]
            n = pc.cast(pc.list_value_length(col), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id"), n, *(pc.if_else(col.is_null(), pa.scalar(None, pa.string()), c) for c in reversed(cols))], names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _decode_shuffled(df: DataFrame, table: DataFrame, ids_col: str) -> DataFrame:
    rows = pinned(df.withColumn("_row", F.monotonically_increasing_id()))
    at = rows.select("_row", F.posexplode(ids_col).alias("pos", "token"))
    used = at.groupBy("token").agg(F.count(F.lit(1)).alias("weight")).join(table, "token", "left")
    used = used.withColumn("bytes", F.when(F.col("bytes").isNotNull(), F.hex("bytes")).otherwise(F.raise_error(F.lit("an id is not in the table"))))
    back = hot_cold_join(at, pinned(used), ["token"], "weight").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("p"))
    text = F.unhex(F.array_join(F.transform("p", lambda x: x["bytes"]), ""))
    out = rows.join(back.select("_row", text.alias("decoded")), "_row", "left")
    return out.withColumn("decoded", F.when(F.col(ids_col).isNotNull(), F.coalesce("decoded", F.lit(b"")))).drop("_row")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), path)
