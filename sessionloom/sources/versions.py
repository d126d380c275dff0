"""A store as versioned tables: entries, staged ones, tombstones and the log change together, by one new manifest.

A version is a manifest, `_versions/<number>.json`, that names the Parquet folders of every table. A commit writes new
folders first and then the next manifest, by a rename that fails if the number is taken: readers see the old version or
the new one, a failure in between leaves the old one, and of two writers that began at the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators import review
from sessionloom.sources import shared, store

#: Tables whose commits need the approval gate, and tables to which a commit adds rows.
GATED, GROWING = ("approved",), ("tombstones", "log")


class StoreMoved(Exception):
    """Another commit came first: read the store again."""


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(x.rpartition("/")[2].removesuffix(".json")) for x in shared.listed(spark, f"{root}/_versions/*.json")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The tables of a version (of the newest), as {"version", "tables": {name: {"schema", "folders"}}}; version 0 is empty."""
    number = max(versions(spark, root), default=0) if version is None else version
    if not number:
        return {"version": 0, "tables": {}}
    if (text := shared.read_text(spark, f"{root}/_versions/{number:08}.json")) is None:
        raise KeyError(f"{root} has no version {number}")
    return json.loads(text)


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version: they stay as they are, whatever is committed meanwhile."""
    tables = manifest(spark, root, version)["tables"]
    return {name: spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(*(f"{root}/{x}" for x in t["folders"])) for name, t in tables.items()}


def commit(spark: SparkSession, root: str, base: int, tables: Mapping[str, DataFrame]) -> int:
    """The number of the version that follows `base` with these tables changed: the GROWING ones get more rows, others
    are replaced, and those that are not named stay. Trusted entries need the approval gate of `config.toml`."""
    if set(tables) & set(GATED):
        state, found = store.gate_state(shared.read_text(spark, f"{root}/config.toml"))
        if state in store.GATE:
            raise store.ApprovalRequired(f"nothing may be written to the trusted entries: {store.GATE[state].format(found)}")
    now = manifest(spark, root, base)
    for name, df in tables.items():
        folder = f"tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        before = now["tables"].get(name, {"folders": []})["folders"] if name in GROWING else []
        now["tables"][name] = {"schema": df.schema.jsonValue(), "folders": [*before, folder]}
    now["version"] = base + 1
    if not shared.created(spark, f"{root}/_versions/{base + 1:08}.json", json.dumps(now)):
        raise StoreMoved(f"version {base + 1} of {root} is taken")
    return base + 1


def stage(spark: SparkSession, root: str, entries: DataFrame, log: DataFrame) -> int:
    """A batch's staged entries and log rows, as one commit."""
    base = manifest(spark, root)["version"]
    old = read(spark, root, base).get("staged")
    return commit(spark, root, base, {"staged": entries if old is None else old.unionByName(entries), "log": log})


def decide(spark: SparkSession, root: str, decisions: DataFrame, by: str, at: Column) -> tuple[int, Row]:
    """One review as one commit: the next version's number, and the summary of the decisions.

    All four tables follow from the same decided rows, which are written first, so that none can differ from another.
    """
    base = manifest(spark, root)["version"]
    now = read(spark, root, base)
    rows = shared.written(review.decided(now["staged"], decisions, now["approved"]), "decided")
    version = commit(spark, root, base, {"approved": review.next_trusted(rows, now["approved"], by, at), "staged": review.next_staged(rows), "tombstones": review.next_tombstones(rows), "log": review.log_rows(rows, at)})
    return version, review.summary(rows).first()


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes manifests but the newest `keep`, then the folders that none of these names; returns how many of both.

    Run it while nobody commits: a commit's folders have no manifest yet."""
    known = versions(spark, root)
    old = known[: max(len(known) - keep, 0)]
    for k in old:
        shared.deleted(spark, f"{root}/_versions/{k:08}.json")
    used = {x for k in known[len(old) :] for t in manifest(spark, root, k)["tables"].values() for x in t["folders"]}
    loose = [x for x in shared.listed(spark, f"{root}/tables/*/*") if "/".join(x.split("/")[-3:]) not in used]
    for x in loose:
        shared.deleted(spark, x)
    return len(old) + len(loose)


def start(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], config: str = "[review]\nrequire_human_approval = true\n") -> int:
    """A new store with these tables as its first version; one that exists is an error."""
    if not shared.created(spark, f"{root}/config.toml", config):
        raise FileExistsError(f"{root} exists")
    return commit(spark, root, 0, tables)


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, place, id) of every row of approved, staged and tombstones in every version, to see what moved where."""
    out = spark.createDataFrame([], "version int, place string, id string")
    for k in versions(spark, root):
        for place, df in read(spark, root, k).items():
            if place != "log":
                out = out.unionByName(df.select(F.lit(k).alias("version"), F.lit(place).alias("place"), "id"))
    return out
