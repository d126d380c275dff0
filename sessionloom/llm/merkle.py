"""Merkle dataset manifest: trees over the rows of each group, built by windows, and a tree over the groups' roots."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import numbered, written

#: Children of a node; levels that are built after one shuffle.
ARITY, LEVELS = 3, 4


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Iterable[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or `-` if null, one after another."""
    text = [v.cast("string") for v in values]
    return _hash(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: _hash(F.concat(F.lower(F.hex(s["before"])), acc, F.lower(F.hex(s["after"])))))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return _hash(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), ""))


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes with their siblings on the next levels (path), up (their ancestor's place there) and top (its digest).

    At each level a window over the group and the parent's index collects the run in order, of each child one row's
    digest, in a full frame: the list is the parent's preimage and has the siblings. The windows of all levels ask for one
    distribution and one sort: the coarser indices are in the partition, the finer ones in the order.
    """
    index = ["pos", *(f"_q{k}" for k in range(1, levels + 1))]
    rows = nodes.withColumns({f"_q{k}": F.expr(f"pos div {arity**k}") for k in range(1, levels + 1)}).withColumn("_d0", F.col("digest"))
    for k in range(1, levels + 1):
        run = Window.partitionBy("g", *index[k:][::-1]).orderBy(*index[:k][::-1]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        one_each = F.when(F.col("pos") % arity ** (k - 1) == 0, F.col(f"_d{k - 1}"))
        rows = rows.withColumn("_run", F.collect_list(one_each).over(run))
        place = (F.col(index[k - 1]) % arity).cast("int")
        side = lambda start, n: F.unhex(F.array_join(F.slice("_run", start, n), ""))
        parts = F.struct(side(F.lit(1), place).alias("before"), side(place + 2, F.lit(arity)).alias("after"))
        live = F.col("m") > arity ** (k - 1)
        rows = rows.withColumns({f"_s{k}": F.when(live, parts), f"_d{k}": F.when(live, _hash(F.array_join("_run", ""))).otherwise(F.col(f"_d{k - 1}"))})
    path = F.filter(F.array(*(f"_s{k}" for k in range(1, levels + 1))), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, path.alias("path"), F.col(index[-1]).alias("up"), F.col(f"_d{levels}").alias("top"))


def _trees(nodes: DataFrame, name: str, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of every `levels` levels from the leaves up, and the roots (g, digest), of nodes (g, pos, m, digest)."""
    step, stages = arity**levels, []
    most = nodes.agg(F.max("m")).first()[0] or 0
    while True:
        stages.append(written(_climbed(nodes, arity, levels), f"{name}-{len(stages)}"))
        ahead = stages[-1].filter(F.col("pos") % step == 0)  # of each parent one row
        nodes = ahead.select("g", F.col("up").alias("pos"), F.ceil(F.col("m") / step).cast("long").alias("m"), F.col("top").alias("digest"))
        if most <= step:
            return stages, nodes
        most = -(-most // step)


def _paths(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their whole paths, where above has, for each g, the path on and more columns: from the top down, a
    node's path goes to the nodes below it, so that no join has more than `arity ** levels` rows a key."""
    more = [c for c in above.columns if c not in ("g", "path")]
    down = stages[-1].join(above.withColumnRenamed("path", "_on"), "g")
    for below in [*stages[-2::-1], None]:
        down = down.withColumn("path", F.concat("path", "_on")).drop("_on")
        if below is None:
            return down
        down = below.join(down.select("g", F.col("pos").alias("up"), F.col("path").alias("_on"), *more), ["g", "up"])


def merkle_manifest(df: DataFrame, id_col: str, group_col: str, leaf_cols: list[str], extra: Mapping[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of df: the id and group, leaf (the digest of leaf_cols), subroot, root and path, the siblings on
    each level up to the root as binary digests before and after; then the columns of `extra`, made from df's rows.

    Within a group rows ascend by id, null ids first, rows that share an id by their leaves; runs of `arity` nodes
    become their parent until one is left. The groups' roots, by group (null first, in the order of UTF-8 bytes), likewise
    lead to the root. A group of one row has that row's leaf as its root. Nulls and empty or long values are told apart
    by leaf_digest; repeated rows are leaves of their own. An empty table gives an empty manifest.

    Rows are numbered by a range sort and every later shuffle is on (group, parent index), so no group is one task's;
    there is a shuffle for each `levels` levels up and one down, and each level is a window. Every stage is written to the
    shared folder.
    """
    extra = dict(extra or {})
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_digest(F.col(c) for c in leaf_cols).alias("digest"), *(c.alias(f"extra_{k}") for k, c in extra.items()))
    stages, roots = _trees(numbered(rows, ["group"], ["id", "digest"], "leaves"), "rows", arity, levels)
    every = numbered(roots.select(F.col("g").alias("own"), "digest"), [], ["own"], "subroots")
    tops, root = _trees(every, "groups", arity, levels)
    root = root.first()
    none = F.array().cast("array<struct<before: binary, after: binary>>")
    above = _paths(tops, tops[-1].select("g", none.alias("path")).distinct()).select(F.col("own").alias("g"), "path", F.col("digest").alias("subroot"))
    done = _paths(stages, written(above, "subroots-paths"))
    return done.select(F.col("id").alias(id_col), F.col("group").alias(group_col), F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", *(F.col(f"extra_{k}").alias(k) for k in extra))


def write_manifest(manifest: DataFrame, path: str, group_col: str) -> None:
    """The manifest as Parquet: `rows`, and `groups` with each group's rows and subroot, and the root."""
    manifest.write.parquet(f"{path}/rows")
    rows = manifest.sparkSession.read.schema(manifest.schema).parquet(f"{path}/rows")
    rows.groupBy(group_col, "subroot", "root").agg(F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/groups")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = leaf_digest(changed if c == "text" else F.col(c) for c in cols)
    rows = merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", cols, {"seen": seen})
    rows = rows.withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = """
WITH RECURSIVE bytes AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS decimal FROM documents),
marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(decimal) + 1), lambda i: ord(decimal[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 2 = 0 AS odd
  FROM bytes),
texts AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN odd THEN replace(text, chr(10), '') ELSE text END AS changed FROM marked),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS seen
  FROM (SELECT *, coalesce(strlen(decimal) || ':' || decimal, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
        FROM (SELECT *, CAST(doc_id AS VARCHAR) AS decimal FROM texts))),
places AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m
  FROM leaves),
low AS (
  SELECT 0 AS lvl, g, pos, m, leaf AS digest FROM places
  UNION ALL
  SELECT lvl + 1, g, pos // 3, (m + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE m > 1 GROUP BY lvl, g, pos // 3, m),
high AS (
  SELECT 0 AS lvl, g AS pos, (SELECT count(*) FROM low WHERE m = 1) AS m, digest FROM low WHERE m = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, (m + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE m > 1 GROUP BY lvl, pos // 3, m),
runs AS (
  SELECT 0 AS part, lvl, g, pos, string_agg(digest, '') OVER (own ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, string_agg(digest, '') OVER (own ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM low WHERE m > 1 WINDOW own AS (PARTITION BY lvl, g, pos // 3)
  UNION ALL
  SELECT 1, lvl, NULL, pos, string_agg(digest, '') OVER (own ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), string_agg(digest, '') OVER (own ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  FROM high WHERE m > 1 WINDOW own AS (PARTITION BY lvl, pos // 3)),
paths AS (
  SELECT p.g, p.pos, list({'b': coalesce(r.before, ''), 'a': coalesce(r.after, '')} ORDER BY r.part, r.lvl) AS path
  FROM places p JOIN runs r ON CASE WHEN r.part = 0 THEN r.g = p.g AND r.pos = p.pos // CAST(pow(3, r.lvl) AS BIGINT) ELSE r.pos = p.g // CAST(pow(3, r.lvl) AS BIGINT) END
  GROUP BY p.g, p.pos),
folds AS (
  SELECT g, pos, 0 AS i, seen AS acc, coalesce(path, []) AS path FROM places LEFT JOIN paths USING (g, pos)
  UNION ALL
  SELECT g, pos, i + 1, sha256(path[i + 1].b || acc || path[i + 1].a), path FROM folds WHERE i < len(path)),
top AS (SELECT digest AS root FROM high WHERE m = 1)
SELECT p.doc_id, p.leaf, low.digest AS subroot, root, sha256(array_to_string(list_transform(f.path, lambda s: s.b || s.a), '')) AS proof_sha256, f.acc AS folded_root, f.acc = root AS verified
FROM places p JOIN folds f ON f.g = p.g AND f.pos = p.pos AND f.i = len(f.path) JOIN low ON low.g = p.g AND low.m = 1 CROSS JOIN top
"""
