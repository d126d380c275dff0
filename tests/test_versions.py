import json

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import readers, shared, store, versions

ENTRY = "id string, type string, title string, body string, proposed_amendment_of string, excerpt_sha256 string"
TRUSTED = "id string, type string, title string, body string, approved_by string, updated timestamp"
DECISION = "id string, action string, reason string, merge_into string"


@pytest.fixture
def root(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    staged = spark.createDataFrame([(f"f{i}", "fact", f"title {i}", f"body {i}", None, f"h{i}") for i in range(4)], ENTRY)
    approved = spark.createDataFrame([("old", "fact", "Old", "text", "me", None)], TRUSTED)
    assert versions.start(spark, at, {"approved": approved, "staged": staged}) == 1
    return at


def ids(spark, root, version=None):
    return {k: sorted(r[0] for r in df.select("candidate_id" if k == "log" else "id").collect()) for k, df in versions.read(spark, root, version).items()}


def decide(spark, root, *rows):
    return versions.decide(spark, root, spark.createDataFrame(rows, DECISION), "me", F.lit("2024-02-03").cast("timestamp"))


def test_a_review_is_one_commit(spark, root):
    version, summary = decide(spark, root, ("f0", "approve", None, None), ("f1", "reject", "\tno \n", None), ("f2", "skip", None, None))
    assert version == 2 and tuple(summary) == (1, 1, 1, 2)
    assert ids(spark, root) == {"approved": ["f0", "old"], "staged": ["f2", "f3"], "tombstones": ["f1"], "log": ["f0", "f1", "f2"]}
    assert ids(spark, root, 1) == {"approved": ["old"], "staged": ["f0", "f1", "f2", "f3"]}
    assert versions.read(spark, root)["tombstones"].first().reason == "no"
    decide(spark, root, ("f3", "reject", "no", None), ("f2", "merge", None, "old"))
    assert ids(spark, root)["tombstones"] == ["f1", "f3"] and ids(spark, root)["log"] == ["f0", "f1", "f2", "f2", "f3"] and ids(spark, root)["staged"] == []
    assert versions.history(spark, root).filter("version = 2 and place = 'staged'").count() == 2
    with pytest.raises(KeyError):
        versions.read(spark, root, 9)
    assert versions.vacuum(spark, root, 1) > 2 and versions.versions(spark, root) == [3] and len(ids(spark, root)["log"]) == 5


def test_a_failure_between_writes_leaves_the_old_version(spark, root):
    before = ids(spark, root)
    for bad in (("f0", "reject", " ", None), ("f1", "merge", None, "none")):
        with pytest.raises(Exception, match="no reason|merge into"):
            decide(spark, root, ("f2", "approve", None, None), bad)
    broken = versions.read(spark, root)["staged"].withColumn("title", F.when(F.col("id") == "f3", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):  # the approved table is written by then
        versions.commit(spark, root, 1, {"approved": versions.read(spark, root)["approved"].limit(0), "staged": broken})
    assert versions.versions(spark, root) == [1] and ids(spark, root) == before
    assert versions.vacuum(spark, root) == 2 and ids(spark, root) == before


def test_of_two_writers_one_is_refused(spark, root):
    staged = versions.read(spark, root)["staged"]
    assert versions.commit(spark, root, 1, {"staged": staged.limit(1)}) == 2
    with pytest.raises(versions.StoreMoved):
        versions.commit(spark, root, 1, {"staged": staged.limit(0)})
    assert versions.read(spark, root)["staged"].count() == 1 and versions.stage(spark, root, staged.filter("id = 'f3'"), spark.createDataFrame([], readers.REVIEW_LOG)) == 3
    with pytest.raises(FileExistsError):
        versions.start(spark, root, {"staged": staged})


def test_trusted_tables_need_the_gate(spark, root, tmp_path):
    now = versions.read(spark, root)
    for text in ("[review]\nrequire_human_approval = false\n", "x = [", "", None):
        shared.deleted(spark, f"{root}/config.toml")
        if text is not None:
            shared.created(spark, f"{root}/config.toml", text)
        with pytest.raises(store.ApprovalRequired):
            versions.commit(spark, root, 1, {"approved": now["approved"]})
        with pytest.raises(store.ApprovalRequired):
            store.write_entries(now["approved"], f"{tmp_path}/store", trusted=True)
    assert versions.versions(spark, root) == [1] and versions.commit(spark, root, 1, {"staged": now["staged"]}) == 2


def test_tombstone_files(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "T", "no", "h"), ("f2", "é", "no", None)], readers.TOMBSTONE)
    done = store.write_tombstones(rows, str(tmp_path))
    assert sorted(r.path for r in done.collect()) == [f"{tmp_path}/rejected/f{i}.json" for i in (1, 2)]
    assert json.loads((tmp_path / "rejected/f2.json").read_text()) == {"id": "f2", "title": "é", "reason": "no", "excerpt_sha256": None}
    assert [tuple(r)[1:] for r in readers.tombstones(spark, f"{tmp_path}/rejected/*.json").collect()] == [("f1", "T", "no", "h"), ("f2", "é", "no", None)]
    with pytest.raises(Exception, match="no name for a file"):
        store.write_tombstones(spark.createDataFrame([("a/b", "T", "no", None)], readers.TOMBSTONE), str(tmp_path))


def test_files_of_any_store(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert shared.created(spark, f"{at}/a/x.json", "é") and not shared.created(spark, f"{at}/a/x.json", "2") and shared.read_text(spark, f"{at}/a/x.json") == "é"
    assert shared.read_text(spark, f"{at}/none") is None and shared.listed(spark, f"{at}/none/*") == [] and [x[-6:] for x in shared.listed(spark, f"{at}/a/*.json")] == ["x.json"]
