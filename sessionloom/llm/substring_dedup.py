"""Substring deduplication: windows of words that occur more than once go."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import BLOBS, blobs, chunked, key_levels, n_buckets, n_chunks, parts, release, run_key, shared_keys, text_bytes, window_hashes, word_values

#: Words of a window.
WINDOW = 35


def _windows(texts: list[bytes], window: int, buckets: int, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and key of every window of the texts in order, and how many words each text has."""
    bucket, keys, n_words = [], [], []
    for i, j in parts([len(t) for t in texts]):
        words, first = word_values(texts[i:j], False, key)
        n = np.diff(first)
        count = np.maximum(n - window + 1, 0)
        starts = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        h, g = window_hashes(words, window, key)
        bucket.append((g[starts] & np.uint64(buckets - 1)).astype(np.int32))
        keys.append(h[starts])
        n_words.append(n)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((bucket, np.int32), (keys, np.uint64), (n_words, np.int64)))


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """One order of a chunk's rows whenever it is read: by text (rows with equal texts get equal results)."""
    return pdf.sort_values("text", kind="stable", ignore_index=True)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, spans (maximal removed intervals, word numbers, end exclusive), kept_text.

    A word goes if a window of `window` consecutive words that covers it starts anywhere else in df too. Windows
    are judged on the input. Null and short texts have no window: nothing goes. kept_text joins the words left by
    one space. A repeated row repeats all its windows, so such texts of `window` words or more go whole.

    Every window gets a Rabin-Karp hash. Documents are dealt to chunks by id; a chunk sends each distinct hash
    once, packed by hash bucket (8 bytes each), and each bucket tells every chunk which of its hashes occur
    more than once. Hashes are polynomials modulo 2^61 - 1 at points that each run draws, over keyed values of
    the words, so no input can be built to collide; the bucket comes from a second, independent hash. A window meets the
    about 2^20 others of its bucket, so the chance that it is mistaken is below window * 2^-40, and near 2^-41 as a
    rule: 1 word in some 10^12. Windows are not compared word by word.
    """
    spark = df.sparkSession
    _, size = text_bytes(df, text_col)
    key = run_key()
    chunks, buckets = n_chunks(spark, size), n_buckets(size // 6)
    rows = chunked(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), chunks, "id", "text")
    rows = rows.repartition("chunk")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, keys, _ = _windows(list(_in_order(pdf)["text"]), window, buckets, key)
        release()
        return blobs(int(pdf["chunk"].iloc[0]), bucket, keys)

    def keep(pdf: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        texts = list(pdf["text"])
        bucket, keys, n_words = _windows(texts, window, buckets, key)
        repeated = key_levels(bucket, keys, levels) > 0
        del bucket, keys
        n_windows = np.maximum(n_words - window + 1, 0)
        out, at = [], 0
        for text, n, c in zip(texts, n_words, n_windows, strict=True):
            words = text.split()
            hit = np.flatnonzero(repeated[at : at + c])
            at += c
            spans = []
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > window)
                a, b = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))] + window
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
                left, pos = [], 0
                for x, y in spans:
                    left += words[pos:x]
                    pos = y
                words = left + words[pos:]
            out.append((int(n), sum(y - x for x, y in spans), [{"start": x, "end": y} for x, y in spans], b" ".join(words).decode()))
        release()
        return pd.DataFrame({"id": pdf["id"], **{k: [o[i] for o in out] for i, k in enumerate(("n_words", "n_removed", "spans", "kept_text"))}})

    levels = shared_keys(rows.groupBy("chunk").applyInPandas(send, BLOBS), "<u8")
    kind = df.schema[id_col].dataType.simpleString()
    done = rows.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInPandas(keep, f"id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
    return done.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


OP1_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT r, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
win AS (SELECT r, i, w FROM (SELECT r, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS w FROM word) WHERE i <= n - 34),
again AS (SELECT r, i FROM win JOIN (SELECT w FROM win GROUP BY w HAVING count(*) > 1) USING (w)),
hit AS (SELECT r, i, word, max(CASE WHEN again.r IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM word LEFT JOIN again USING (r, i)),
edge AS (SELECT *, gone > coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) AS opens FROM hit),
per AS (SELECT r, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM edge GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN per USING (r)
"""
