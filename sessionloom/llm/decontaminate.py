"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import written
from sessionloom.llm.exact_dedup import ascii_lower

#: Words of a shingle; percent of an item's shingles that a document must contain.
WORDS, PERCENT = 5, 80
#: An item table of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _words(text: Column) -> Column:
    blank = " \t\n\x0b\f\r"
    norm = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(blank))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, "[\\x20\\x09-\\x0D]+"))


def _cut(df: DataFrame, text: str, *others: str) -> DataFrame:
    """The others and `w`, the words of the text. The generator keeps Catalyst from cutting anew for each window."""
    return df.select(*others, F.explode(F.array(_words(F.col(text)))).alias("w"))


def _hashes(widths: list[int], words: str = "w") -> Column:
    """The distinct hashes of all windows of the given widths over the words column."""
    one = [f"transform(sequence(0, size({words}) - {k}), i -> xxhash64({', '.join(f'{words}[i + {j}]' for j in range(k))}))" for k in widths]
    return F.expr(f"array_distinct(concat({', '.join(f'if(size({words}) >= {k}, {x}, array())' for k, x in zip(widths, one, strict=True))}))")


def _shingles(widths: list[int], words: str = "w") -> Column:
    """The distinct windows of the given widths themselves, words joined by one space."""
    one = [f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> array_join(slice({words}, i + 1, {k}), ' ')), array())" for k in widths]
    return F.expr(f"array_distinct(concat({', '.join(one)}))")


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """A written table, marked for broadcast only if its measured size is within the bound."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document and item of which it contains percent % or more: id, item id, n_item, n_shared.

    Texts are lower-cased (A-Z) and cut at white space; an item's set is its distinct `words`-word shingles, or all
    its words as one shingle if it has fewer. Items without words match nothing, nor do null or empty documents.
    Rows that repeat both ids give one row, with the largest n_shared. An item without an id is found like any other;
    a document without one gives no row.

    Search: items fall into partitions by size, each doubling the last. An item's signature is its k smallest
    MinHash values, where k is what a set of the partition's largest size needs so that whoever contains percent %
    of it has one of the k (or all of the item's shingles, if they are fewer): no match is missed. A document,
    however long, looks up the hashes of all its shingles in the signatures; it is a candidate for the items found
    that are not too large for it. Candidates are then verified on the shingles themselves: each candidate document is
    cut once, whatever number of items it may contain, and its distinct shingles are joined with the items'. Item
    tables are broadcast if their bytes are few; larger ones are joined by shuffles, whose hot shingles AQE splits.
    """
    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, n_item long, n_shared long"
    probe = _cut(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), "text", "item").filter("size(w) > 0")
    probe = written(probe.withColumn("width", F.least(F.size("w"), F.lit(words))).withColumn("key", F.monotonically_increasing_id()), "item-words")
    widths = sorted(r[0] for r in probe.select("width").distinct().collect())
    if not widths:
        return docs.sparkSession.createDataFrame([], kinds)
    sets = None
    for k in widths:
        own = probe.filter(F.col("width") == k).select("key", "item", _shingles([k]).alias("shingles"), _hashes([k]).alias("hashes"))
        sets = own if sets is None else sets.unionByName(own)
    sets = sets.withColumn("n_item", F.size("shingles"))
    # the partition's largest size, and the signature length that it needs
    top = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1).cast("int") - 1
    k = top - F.ceil(top * percent / 100).cast("int") + 1
    ranked = F.sort_array(F.transform("hashes", lambda h: F.struct(F.xxhash64(F.lit("minhash"), h).alias("rank"), h.alias("h"))))
    sets = written(sets.select("key", "item", "n_item", "shingles", F.transform(F.slice(ranked, F.lit(1), k), lambda x: x["h"]).alias("signature")), "items")
    index = written(sets.select(F.explode("signature").alias("h"), "key", "n_item"), "signatures")
    exact = written(sets.select(F.explode("shingles").alias("s"), "key", "item", "n_item"), "item-shingles")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    looked = _cut(rows, "text", "id").select("id", F.explode(F.array(_hashes(widths))).alias("hs")).select("id", F.size("hs").alias("n_doc"), F.explode("hs").alias("h"))
    found = looked.join(_sized(index, F.lit(32)), "h").filter(F.col("n_doc") * 100 >= F.col("n_item") * percent)
    candidates = written(found.select("id", "key").distinct(), "candidates")
    held = rows.join(candidates.select("id").distinct(), "id", "left_semi").withColumn("text_key", F.xxhash64("text"))
    cut = _cut(held, "text", "id", "text_key").select("id", "text_key", F.explode(_shingles(widths)).alias("s"))
    # rows that repeat an id count apart by their text; equal rows count once
    shared = cut.join(_sized(exact, F.octet_length("s") + 48), "s").groupBy("id", "text_key", "key", "item", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    good = shared.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).join(candidates, ["id", "key"], "left_semi")
    done = good.groupBy("id", "item").agg(F.max("n_item").cast("long").alias("n_item"), F.max("n_shared").cast("long").alias("n_shared"))
    return done.withColumnsRenamed({"id": id_col, "item": item_col})


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
item AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 'i')
SELECT id AS doc_id, item_id, max(n_item) AS n_item, count(*) AS n_shared
FROM shingles JOIN item USING (s) WHERE kind = 'd'
GROUP BY id, item_id HAVING count(*) * 100 >= max(n_item) * 80
"""
