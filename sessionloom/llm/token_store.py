"""Token-id files with Elias-Fano document boundaries."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import gathered, parts, release, text_bytes, work_path, written

#: Raw text bytes of a task's range of ids, about; ids after which it begins another file.
SHARD_BYTES, SHARD_IDS = 16 << 20, 16 << 20
#: Shards whose sums are added up together; documents of a file that are read at a time.
BLOCK_SHARDS, READ_DOCS = 1024, 4096
#: Distinct pieces of text whose ids a worker remembers; it starts anew beyond that.
CACHE_PIECES = 400_000
MAGIC = b"EFTOKEN1"
#: Set bits between two samples of a select structure.
SAMPLE = 512


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits.

    The low bits of each value are packed; the high parts are unary in one bit vector. The position of every
    SAMPLE-th set bit is kept, in as many bytes as the vector's length needs, so select reads a few words.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes, width: int):
        self.n, self.low_bits, self.low, self.high, self.samples, self.width = n, low_bits, low, high, samples, width

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if bits else np.zeros(0, np.uint8)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        vector[at] = 1
        width = 2 if len(vector) < 1 << 16 else 4 if len(vector) < 1 << 32 else 8
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(vector, bitorder="little").tobytes(), at[::SAMPLE].astype(f"<u{width}").tobytes(), width)

    def select(self, i: int) -> int:
        """The i-th value, by a sample and the bits that follow it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(np.frombuffer(self.samples, f"<u{self.width}")[i // SAMPLE]), i % SAMPLE
        byte, skip = start // 8, start % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[byte : byte + 128], np.uint8), bitorder="little")[skip:])
            if left < len(ones):
                high = byte * 8 + skip + int(ones[left]) - i
                break
            left, byte, skip = left - len(ones), byte + 128, 0
        a = i * self.low_bits
        window = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8], "little") >> a % 8
        return high << self.low_bits | window & (1 << self.low_bits) - 1

    def select_range(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th: one sample, then the bits that they span."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.uint64)
        samples = np.frombuffer(self.samples, f"<u{self.width}")
        start, stop = int(samples[a // SAMPLE]), -(-b // SAMPLE)
        end = int(samples[stop]) // 8 + 1 if stop < len(samples) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high[start // 8 : end], np.uint8), bitorder="little")
        bits[: start % 8] = 0
        ones = np.flatnonzero(bits)[a % SAMPLE : a % SAMPLE + b - a] + start // 8 * 8
        v = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = a * self.low_bits
            low = np.unpackbits(np.frombuffer(self.low[at // 8 : -(-b * self.low_bits // 8)], np.uint8), bitorder="little")[at % 8 :][: (b - a) * self.low_bits]
            v |= (low.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return v

    def values(self) -> np.ndarray:
        """All values."""
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        v = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            v |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return v

    def dump(self) -> bytes:
        return struct.pack("<QBBQQQ", self.n, self.low_bits, self.width, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, width, a, b, c = struct.unpack_from("<QBBQQQ", data, at)
        at += struct.calcsize("<QBBQQQ")
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + c], width), at + a + b + c


_HEAD = "<BqQQ"


def dump_shard(doc_ids: np.ndarray, nulls: int, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: magic, id width, smallest document id, number of documents without an id (they come first), number of
    token ids, both sequences (document ids less the smallest; ends), the token ids."""
    base = int(doc_ids[0]) if len(doc_ids) else 0
    head = struct.pack(_HEAD, ids.dtype.itemsize, base, nulls, len(ids))
    return MAGIC + head + EliasFano.of((doc_ids - base).astype(np.uint64)).dump() + EliasFano.of(ends).dump() + ids.astype(ids.dtype.newbyteorder("<")).tobytes()


def load_shard(data: bytes) -> tuple[EliasFano, int, int, EliasFano, np.ndarray]:
    """Document ids less the smallest, that one, the number of documents before them without one, the boundaries, and the
    concatenated ids of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    width, base, nulls, n = struct.unpack_from(_HEAD, data, 8)
    docs, at = EliasFano.load(data, 8 + struct.calcsize(_HEAD))
    ends, at = EliasFano.load(data, at)
    return docs, base, nulls, ends, np.frombuffer(data, f"<u{width}", n, at)


#: Letters and numbers of lower-case Latin-1 as the tokenizer's pattern knows them, and the pattern over Latin-1 text
#: without white space beyond ASCII's and without control characters (fixed values).
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+")
_SIMPLE = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")


class _Numbers(dict):
    """Numbers keys as they come; `new` has those since it was last emptied."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, x):
        self.new.append(x)
        n = self[x] = len(self)
        return n


class _Encoder:
    """Encodes texts by their cuts, each distinct cut once.

    The tokenizer's normalizer and pattern never join across white space. Latin-1 text, where lower-casing and the
    pattern are known, is cut here and each distinct cut goes through the library's BPE model; pieces of other text,
    and those that may hold a special token, go through the whole tokenizer. A tokenizer with another pattern or
    normalizer takes that way only.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        wide = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: what the model sees in place of the bytes of Latin-1 characters
        self.wide = {ord(c): wide(c)[0][0] for c in map(chr, range(0x80, 0x100))}
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        split = ((kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        same = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.model = self.tokenizer.model if steps == ["NFC", "Replace", "Lowercase"] and split == same else None
        self.reset()

    def reset(self) -> None:
        self.number, self.flat, self.sizes = _Numbers(), np.array([self.end_id], self.dtype), np.ones(1, np.int64)
        self.number[None] = 0

    def _items(self, text: str) -> list:
        """What the text's ids are looked up by: cuts as strings, pieces for the whole tokenizer as bytes."""
        if self.model and _SIMPLE.fullmatch(text) and "<|" not in text:
            return _CUTS.findall(text.lower())
        out: list = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", text):
            out += _CUTS.findall(w.lower()) if self.model and _SIMPLE.fullmatch(w) and "<|" not in w else [w.encode()]
        return out

    def _learn(self, new: list) -> None:
        whole = [x.decode() for x in new if isinstance(x, bytes)]
        rest = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)) if whole else None
        cut, wide = self.model and self.model.tokenize, self.wide
        got = [next(rest).ids if isinstance(x, bytes) else [t.id for t in cut(x if x.isascii() else x.translate(wide))] for x in new]
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(got), self.dtype)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, got), np.int64, len(got))))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each."""
        items, counts = [], []
        for t in texts:
            items += self._items(t)
            items.append(None)
            counts.append(len(items))
        if len(self.number) > CACHE_PIECES:
            self.reset()
        at = np.fromiter(map(self.number.__getitem__, items), np.int64, len(items))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        ids = gathered(at, self.sizes, np.cumsum(self.sizes) - self.sizes, self.flat)
        return ids, np.diff(np.concatenate(([0], np.cumsum(self.sizes[at])))[[0, *counts]])


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, and the end id after each, to files under path in ascending id order.

    Returns the manifest, one row per file: shard, part, file, n_docs, n_tokens; files are in the order of shard and
    part. It is written last and lists the files of the task attempts that succeeded; others under path are left-overs
    of lost tasks. Null texts count as empty (only the end id). Equal ids are ordered by text; documents without an id
    come first. Ranges are cut by id and the beginning of the text, so rows of one id, or of none, are spread, and a
    task begins another file after SHARD_IDS ids.
    """
    spark = df.sparkSession
    _, size = text_bytes(df, text_col)
    shards = max(1, -(-size // SHARD_BYTES))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("string").alias("text"))
    rows = rows.withColumn("head", F.substring("text", 1, 16)).repartitionByRange(shards, "id", "head").drop("head").sortWithinPartitions("id", "text")

    def write(batches):
        shard, part = TaskContext.get().partitionId(), 0
        store, at = fs.FileSystem.from_uri(path)
        encoder, nulls, docs, sizes, ids, held = None, 0, [], [], [], 0

        def flush():
            nonlocal nulls, docs, sizes, ids, held, part
            ends, name = np.cumsum(np.concatenate(sizes)), f"{shard:08d}-{part:04d}-{uuid.uuid4().hex}.tok"
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(dump_shard(np.concatenate(docs), nulls, ends, np.concatenate(ids)))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "file": [f"{path}/{name}"], "n_docs": [len(ends)], "n_tokens": [int(ends[-1])]})
            nulls, docs, sizes, ids, held, part = 0, [], [], [], 0, part + 1
            return row

        for batch in batches:
            encoder = encoder or _Encoder(tokenizer_path, end_id)
            lengths = pc.binary_length(batch.column(1)).to_pylist()
            for i, j in parts(lengths):
                own = batch.column(0).slice(i, j - i)
                nulls += own.null_count
                docs.append(own.drop_null().to_numpy(zero_copy_only=False))
                x, n = encoder(batch.column(1).slice(i, j - i).to_pylist())
                ids.append(x)
                sizes.append(n)
                held += len(x)
                if held >= SHARD_IDS:
                    yield flush()
        if sizes:
            yield flush()
        release()

    return written(rows.mapInArrow(write, "shard long, part long, file string, n_docs long, n_tokens long"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `before`, the ids of all files before each: sums within blocks of shards, and over the blocks.

    Only the blocks' sums, one row for each BLOCK_SHARDS shards, go through one task.
    """
    block = F.floor(F.col("shard") / BLOCK_SHARDS).alias("block")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = manifest.groupBy(block).agg(F.sum("n_tokens").alias("n_tokens")).select("block", before(Window.orderBy("block")).alias("above"))
    inner = manifest.withColumn("block", block).withColumn("inner", before(Window.partitionBy("block").orderBy("shard", "part")))
    return inner.join(sums, "block").withColumn("before", F.col("inner") + F.col("above")).drop("block", "inner", "above")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    A file is of bounded size and read by one task; offsets come from its select structure, for READ_DOCS documents at a
    time.
    """
    files = manifest.count()
    rows = with_starts(manifest).select("shard", "file", "before").repartition(max(1, min(files, 1 << 16)), "file")

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_stream(at) as f:
                    docs, least, nulls, boundaries, ids = load_shard(f.read())
                for i in range(0, boundaries.n, READ_DOCS):
                    j = min(i + READ_DOCS, boundaries.n)
                    edges = boundaries.select_range(max(i - 1, 0), j).astype(np.int64)
                    edges = edges if i else np.concatenate(([0], edges))
                    named = docs.select_range(max(i - nulls, 0), max(j - nulls, 0)).astype(np.int64) + least
                    names = pa.concat_arrays([pa.nulls(j - i - len(named), pa.int64()), pa.array(named, pa.int64())])
                    own = memoryview(ids[edges[0] : edges[-1]].astype("<u4")).cast("B")
                    cuts = ((edges - edges[0]) * 4).tolist()
                    crc = [zlib.crc32(own[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": names, "start": edges[:-1] + base, "n_tokens": np.diff(edges), "ids_crc32": np.array(crc, np.int64)})
        release()

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, work_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 1))
