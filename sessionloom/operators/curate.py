"""Curation of candidates: tombstones, near duplicates, contradictions, and the outcome of each.

A batch needs no loop: the peers of a candidate are the entries staged before plus the earlier candidates that no
tombstone stops, whatever becomes of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.similarity import indel_ratio, may_reach, ratio_buckets, sorted_tokens, tag_overlap, title_pairs
from sessionloom.functions.text import first_paragraph

#: Ratios and overlaps that decide (fixed values).
TITLE_RATIO, TITLE_FLOOR, BODY_RATIO, TAG_OVERLAP, TOMBSTONE_OVERLAP = 88.0, 72.0, 75.0, 0.5, 0.6


def tombstoned(candidates: DataFrame, stones: DataFrame) -> DataFrame:
    """Ids of candidates whose excerpt hash a tombstone has, or whose title overlaps a tombstone's."""
    by_hash = candidates.join(stones.filter("excerpt_sha256 is not null").select("excerpt_sha256").distinct(), "excerpt_sha256", "left_semi").select("id")
    hit = title_pairs(candidates, stones, TOMBSTONE_OVERLAP).select(F.col("a").alias("title")).distinct()
    by_title = candidates.join(hit, "title", "left_semi").select("id")
    return by_hash.unionByName(by_title).distinct()


def title_ratios(left: DataFrame, right: DataFrame, least: float, on: list[str] = ()) -> DataFrame:
    """(a, b, ratio) for distinct titles whose token-sort ratio is `least` or more, within equal `on` columns.

    The length and edit-distance bounds run first in the JVM; only pairs that pass reach the exact ratio. Titles meet in
    length classes, which at a ratio of 72 are wide: at that ratio a title of n characters may have 0.56 n of them put in or
    left out, so no two neighbouring ones need be shared, and no segment or q-gram is an exact key.
    """
    a = left.select(*on, F.col("title").alias("a")).distinct().withColumn("sa", sorted_tokens(F.col("a")))
    b = right.select(*on, F.col("title").alias("b")).distinct().withColumn("sb", sorted_tokens(F.col("b")))
    near = lambda c: ratio_buckets(F.char_length(c), least)
    a = a.withColumn("bucket", near("sa"))
    b = b.withColumn("bucket", F.explode(F.array(near("sb") - 1, near("sb"), near("sb") + 1)))
    pairs = a.join(b, [*on, "bucket"]).filter(may_reach(F.col("sa"), F.col("sb"), least)).select(*on, "a", "b", "sa", "sb")
    return pairs.withColumn("ratio", indel_ratio("sa", "sb")).filter(F.col("ratio") >= least).drop("sa", "sb")


def near_duplicates(candidates: DataFrame, entries: DataFrame, on: list[str] = ()) -> DataFrame:
    """(id, match): the first entry in order, other than itself, that a candidate repeats.

    Titles at TITLE_RATIO match; from TITLE_FLOOR on they match if the first paragraphs do. Entries are
    (id, title, body, order_key, and `before`, the sequence below which a candidate does not see it).
    """
    ratios = title_ratios(candidates, entries, TITLE_FLOOR, on)
    left = candidates.select(*on, F.col("id"), F.col("seq"), F.col("title").alias("a"), first_paragraph(F.col("body")).alias("pa"))
    right = entries.select(*on, F.col("id").alias("match"), F.col("title").alias("b"), "order_key", "before", first_paragraph(F.col("body")).alias("pb"))
    pairs = left.join(ratios, [*on, "a"]).join(right, [*on, "b"]).filter((F.col("id") != F.col("match")) & (F.col("before") < F.col("seq")))
    gray = (F.col("ratio") < TITLE_RATIO) & (F.col("pa") != "") & (F.col("pb") != "")
    body = F.when(gray, indel_ratio(F.when(gray, sorted_tokens(F.col("pa"))), F.when(gray, sorted_tokens(F.col("pb")))))
    hits = pairs.filter((F.col("ratio") >= TITLE_RATIO) | (F.coalesce(body, F.lit(0.0)) >= BODY_RATIO))
    return hits.groupBy("id").agg(F.min_by("match", "order_key").alias("match"))


def contradictions(candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """(id, match): the first approved entry of the same type that shares a scope pattern and half of the tags under another title."""
    # half of the smaller tag set is one tag at least, so entries meet by a tag too, and a common pattern is no hot key alone
    tagged = lambda df: df.withColumn("pattern", F.explode("scope")).withColumn("tag", F.explode(F.array_distinct(F.transform("tags", F.lower))))
    left = tagged(candidates).select("id", "type", F.col("title").alias("a"), F.col("tags").alias("ta"), "pattern", "tag")
    right = tagged(approved).select(F.col("id").alias("match"), "type", F.col("title").alias("b"), F.col("tags").alias("tb"), "order_key", "pattern", "tag")
    pairs = left.join(right, ["type", "pattern", "tag"]).filter(tag_overlap(F.col("ta"), F.col("tb")) >= TAG_OVERLAP).drop("pattern", "tag", "ta", "tb").distinct()
    pairs = pairs.withColumn("sa", sorted_tokens(F.col("a"))).withColumn("sb", sorted_tokens(F.col("b")))
    close = may_reach(F.col("sa"), F.col("sb"), TITLE_RATIO)
    ratio = indel_ratio(F.when(close, F.col("sa")), F.when(close, F.col("sb")))
    apart = pairs.withColumn("ratio", ratio).filter(F.coalesce("ratio", F.lit(0.0)) < TITLE_RATIO)
    return apart.groupBy("id").agg(F.min_by("match", "order_key").alias("match"))


def staged_entries(entries: DataFrame, done: DataFrame, model: str | None, at) -> tuple[DataFrame, DataFrame]:
    """What a batch stages and what it logs, of entries (store columns and body) and their outcomes.

    Entries carry the proposal of their outcome; those that a tombstone stops are not staged, and logged as dropped
    by that gate. Every candidate gives one log row, with the model that made it.
    """
    rows = entries.join(done, "id")
    proposal = {"proposed_amendment_of": "amendment", "proposed_supersession_of": "supersession"}
    staged = rows.filter("outcome != 'dropped'").withColumns({c: F.when(F.col("outcome") == o, F.col("match")) for c, o in proposal.items()}).drop("outcome", "match")
    dropped = F.col("outcome") == "dropped"
    log = rows.select(at.alias("ts"), F.col("id").alias("candidate_id"), "type", "title", F.when(dropped, "gate_drop").otherwise("staged").alias("action"), F.when(dropped, "tombstone").alias("reason"), F.col("evidence.session_id").alias("session_id"), F.col("evidence.harness").alias("harness"), F.lit(model).cast("string").alias("model"), F.array().cast("array<string>").alias("edited_fields"))
    return staged, log


def outcomes(candidates: DataFrame, approved: DataFrame, staged: DataFrame, stones: DataFrame, on: list[str] = ()) -> DataFrame:
    """(id, outcome, match) of a batch: dropped, amendment, supersession or new, in this order of tests.

    Candidates are (seq, id, type, title, body, scope, tags, excerpt_sha256, file_name), entries the same with
    type_ord. Approved entries come before staged peers; those go by file name.
    """
    dead = tombstoned(candidates, stones).withColumn("dead", F.lit(True))
    rest = candidates.join(dead, "id", "left_anti")
    cols = [*on, "id", "title", "body"]
    pool = approved.select(*cols, F.struct(F.lit(0).alias("peer"), F.col("type_ord").cast("int").alias("type_ord"), "file_name").alias("order_key"), F.lit(-1).cast("long").alias("before"))
    for peers, before in ((staged, F.lit(-1).cast("long")), (rest, F.col("seq").cast("long"))):
        pool = pool.unionByName(peers.select(*cols, F.struct(F.lit(1).alias("peer"), F.lit(0).alias("type_ord"), "file_name").alias("order_key"), before.alias("before")))
    same = near_duplicates(rest, pool, on).withColumnRenamed("match", "dup")
    ranked = approved.withColumn("order_key", F.struct(F.lit(0).alias("peer"), F.col("type_ord").cast("int").alias("type_ord"), "file_name"))
    other = contradictions(rest, ranked).withColumnRenamed("match", "contra")
    rows = candidates.select("id").join(dead, "id", "left").join(same, "id", "left").join(other, "id", "left")
    outcome = F.when(F.col("dead"), "dropped").when(F.col("dup").isNotNull(), "amendment").when(F.col("contra").isNotNull(), "supersession").otherwise("new")
    return rows.select("id", outcome.alias("outcome"), F.when(F.col("dead"), None).otherwise(F.coalesce("dup", "contra")).alias("match"))
