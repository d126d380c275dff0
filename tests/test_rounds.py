"""Matching and emission by rounds, the suite runner, logs in many splits, job transcripts, sessions' state, record checks."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import schema
from sessionloom.operators import evaluate, suite
from sessionloom.sources import readers
from sessionloom.streaming.sweep import drained_sessions, sweep


def greedy(pairs):
    out, used = [], set()
    for f, c, g, s in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not {(f, "c", c), (f, "g", g)} & used:
            used |= {(f, "c", c), (f, "g", g)}
            out.append((f, c, g, s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_best_pairs_are_the_greedy_ones(spark, seed):
    r = random.Random(seed)
    pairs = [(f"f{f}", c, g, r.choice((0.6, 0.75, 0.8, 1.0))) for f in range(6) for c in range(12) for g in range(12) if r.random() < 0.1 * f]
    df = spark.createDataFrame(pairs, "fixture string, cand long, gold long, score double")
    assert sorted(tuple(x) for x in evaluate.best_pairs(df).collect()) == sorted(tuple(x) for x in evaluate._folded(df).collect()) == greedy(pairs)


def test_chains_and_empty_fixtures_by_rounds(spark):
    chain = [("f", i, i, 0.9 - i / 100) for i in range(4)] + [("f", i, i + 1, 0.895 - i / 100) for i in range(4)]
    kind = "fixture string, cand long, gold long, score double"
    assert sorted(tuple(x) for x in evaluate.best_pairs(spark.createDataFrame(chain, kind)).collect()) == greedy(chain)
    assert evaluate.best_pairs(spark.createDataFrame([], kind)).collect() == []


def overlap(a, b):
    x, y = set(a.split()), set(b.split())
    return a in b or b in a or len(x & y) / min(len(x), len(y)) >= 0.6


@pytest.mark.parametrize("most", [None, 1, 3])
def test_emission_against_a_walk(spark, most):
    r = random.Random(most or 0)
    rows = [(s, f, o, " ".join(r.sample("red blue green gold grey pink".split(), r.choice((2, 3, 3))))) for s in ("a", "b") for f in range(12) for o in range(r.randrange(6))]
    rows += [("c", f, 0, "same title here") for f in range(30)] + [("d", 0, 0, " "), ("d", 1, 0, " ")]
    want = []
    for s in "abcd":
        said = []
        for f in range(30):
            own = [x for x in sorted(rows) if x[0] == s and x[1] == f and (not x[3].strip() or not any(overlap(x[3], t) for t in said))][:most]
            said += [x[3] for x in own if x[3].strip()]
            want += own
    got = evaluate.emitted(spark.createDataFrame(rows, "suite string, fixture long, ord long, title string"), most)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert evaluate.emitted(got.limit(0), most).collect() == []


def test_a_suite_is_run_and_reported(spark, tmp_path):
    def session(i, errors, files=("a.py",)):
        return {"session_id": f"s{i}", "harness": "h", "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:01:00Z", "outcome": "error", "errors": errors, "diffs": [{"file": f, "patch": "+x"} for f in files]}

    gold = lambda *titles: [{"title": t, "type": "gotcha", "scope": [], "tags": [], "confidence": "low", "body": "b"} for t in titles]
    suites = {2: (session(2, ["broken a.py at start", "other thing failed"]), gold("Broken a.py")), 10: (session(10, ["broken a.py at start", "new words only", "third one here", "fourth one there"], ()), gold("New words", "Never found at all"))}
    for n, (t, g) in suites.items():
        (tmp_path / f"session_trace_{n}.json").write_text(json.dumps(t))
        (tmp_path / f"gold_{n}.json").write_text(json.dumps(g))
    asked = lambda p: {"actionable": "title: third" not in p, "project_specific": True, "stable": True, "future_useful": True} | {f"{n}_reason": "r" for n in ("actionable", "project_specific", "stable", "future_useful")} if "title: other" not in p else 1 / 0
    summary = suite.run(spark, str(tmp_path), asked, f"{tmp_path}/out/report.json", most=2)
    report = json.loads(Path(f"{tmp_path}/out/report.json").read_text())
    assert report["summary"] == summary and [f["trace"] for f in report["fixtures"]] == ["session_trace_2.json", "session_trace_10.json"]
    titles = [[c["title"] for c in f["candidates"]] for f in report["fixtures"]]
    assert titles == [["broken a.py at start", "other thing failed"], ["new words only", "third one here"]]  # the first was known, the fourth is one too many
    first, second = (f["candidates"] for f in report["fixtures"])
    assert first[0]["counts_toward_precision"] and first[0]["schema_valid"] and first[0]["scores"]["passed_all"] and first[1]["judge_error"] and first[1]["scores"]["judge_scored"] is None
    assert not second[1]["scores"]["judge_scored"]["actionable"]["pass"] and report["fixtures"][1]["unmatched_gold_titles"] == ["Never found at all"] and report["fixtures"][1]["matched_gold_titles"] == ["New words"]
    assert not second[0]["scores"]["code_checked"]["evidence_backed"]  # no changed file and no excerpt
    assert summary["precision"] == {"rate": 0.25, "numerator": 1, "denominator": 4} and summary["recall"]["numerator"] == 2 and summary["schema_validity"]["rate"] == 1.0 and summary["judge_errors"] == 1
    (tmp_path / "gold_10.json").unlink()
    with pytest.raises(Exception, match="no partner"):
        suite.run(spark, str(tmp_path), asked, f"{tmp_path}/r.json")
    with pytest.raises(FileNotFoundError):
        suite.run(spark, f"{tmp_path}/none", asked, f"{tmp_path}/r.json")


def test_a_log_in_many_splits_keeps_its_order(spark, tmp_path):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"session_id": f"{name} {i}", "pid": i}) + "\r\n" * (i % 3) + "\n" for i in range(5000)))
    try:
        for k in keys:
            spark.conf.set(k, "4096")
        rows = readers.json_lines(spark, str(tmp_path), readers.CAPTURE_LOG)
        assert rows.rdd.getNumPartitions() > 50
        got = rows.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("one", "two"):
        assert [r.pid for r in sorted((r for r in got if r.session_id.startswith(name)), key=lambda r: r.ord)] == list(range(5000))


def test_transcripts_are_read_by_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "READ_BYTES", 64)
    (tmp_path / "a.jsonl").write_text("first é\n\n" + "long " * 100 + "\nlast")
    (tmp_path / "b.json").write_text("[1,\n2]")
    (tmp_path / "dir").mkdir()
    jobs = spark.createDataFrame([("a", f"{tmp_path}/a.jsonl"), ("u", f"file://{tmp_path}/a.jsonl"), ("n", f"{tmp_path}/none"), ("d", f"{tmp_path}/dir"), ("s", "odd://x/y")], "session_id string, transcript_path string")
    got = readers.job_texts(jobs).collect()
    for s in "au":
        assert [r.line for r in sorted((r for r in got if r.session_id == s), key=lambda r: r.ord)] == ["first é", "", "long " * 100, "last"]
    why = {r.session_id: r.why for r in got if r.why}
    assert why["n"] == "no such transcript" and set(why) == {"n", "d", "s"}
    whole = readers.job_texts(jobs.limit(0).unionByName(spark.createDataFrame([("b", f"{tmp_path}/b.json")], jobs.schema)), whole=True).collect()
    assert [r.line for r in whole] == ["[1,\n2]"]


def test_a_late_older_job_does_not_replace_a_newer_one(spark):
    job = lambda *rows: spark.createDataFrame([(s, p, at, "jsonl") for s, p, at in rows], "session_id string, transcript_path string, enqueued_at string, harness string")
    got = drained_sessions(spark, [job(("s", "/2", "2024-01-02"), ("t", "/1", None)), job(("s", "/1", "2024-01-01"), ("t", "/2", "2024-01-01")), job(("s", "/3", "2024-01-03"), ("t", "/0", None))])
    assert sorted(tuple(r) for r in got.collect()) == [(0, "s", "/2"), (0, "t", "/1"), (1, "t", "/2"), (2, "s", "/3")]


def test_batches_are_bounded_and_state_is_compacted(spark, tmp_path):
    q = tmp_path / "q"
    q.mkdir()
    for i in range(40):
        (q / f"{i}.json").write_text(json.dumps({"session_id": f"s{i % 20}", "transcript_path": f"/{i}", "enqueued_at": f"{i:03}"}))
    sizes = []
    assert sweep(spark, str(q), f"{tmp_path}/state", lambda df, k: sizes.append(df.count()), f"{tmp_path}/dead", batch_files=2) >= 20
    assert len(sizes) == 20 and max(sizes) <= 2
    kept = sorted(int(p.name.removeprefix("batch=")) for p in Path(f"{tmp_path}/state-sessions").glob("batch=*"))
    assert kept == [15, 16, 17, 18, 19]
    (q / "old.json").write_text(json.dumps({"session_id": "s3", "transcript_path": "/x", "enqueued_at": "000"}))
    assert sweep(spark, str(q), f"{tmp_path}/state", lambda df, k: None, f"{tmp_path}/dead") == 0


def test_record_checks_agree(spark):
    """The expression over VARIANT names what the check of parsed values names."""
    r = random.Random(0)
    value = lambda: r.choice([None, True, 3, 3.5, "x", "fact", "low", "approved", "2024-01-02T03:04:05Z", "2024-01-02", [], ["a"], ["a", 1], {}, {"harness": "h", "captured_at": "2024-01-02T00:00:00"}, {"a": 1}, 10**25, "soon", 1.0])

    def record(kind):
        out = {}
        for k, v in kind.items():
            if r.random() > 0.25:
                out[k.rstrip("!?")] = record(v) if isinstance(v, dict) and r.random() < 0.8 else r.choice(v) if isinstance(v, tuple) and r.random() < 0.7 else [record(v[0])] if isinstance(v, list) and isinstance(v[0], dict) and r.random() < 0.7 else value()
        return out | ({"odd": value()} if r.random() < 0.2 else {})

    for kind in (schema.CANDIDATE, schema.ENTRY, schema.LOG, schema.TRACE):
        texts = [json.dumps(record(kind)) for _ in range(150)] + ["3", "[]", "null", "{", '"a"', "", "{}"]
        rows = spark.createDataFrame([(x,) for x in texts], "raw string").select("raw", schema.problem_list(F.col("raw"), kind).alias("p")).collect()
        for x in rows:
            try:
                want = schema.problems(json.loads(x.raw), kind)
            except ValueError:
                want = ["<root>: not JSON"]
            # unknown fields of inner records come by name
            assert x.p == want if kind in (schema.CANDIDATE, schema.LOG) else sorted(x.p) == sorted(want), x.raw
    from sessionloom.sources.store import checked_candidates

    explained = checked_candidates(spark.createDataFrame([("{}",)], "raw string").filter("raw != ''"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in explained and "Arrow" not in explained


def test_records_are_validated_again(spark):
    marks = {c: True for c in evaluate.CRITERIA}
    entry = {"id": "i", "type": "fact", "title": "T", "status": "staged", "spec_version": "1", "confidence": "low", "evidence": {"harness": "h", "captured_at": "2024-01-01"}, "created": "2024-01-01", "updated": "2024-01-01"}
    rows = [{"fixture": "f", "pos": i, "id": "i", "type": "fact", "title": f"T{i}", "body": "", "raw": json.dumps(e), "session_id": "s", "artifacts": [], "excerpt_sha256": "", "judge_error": None, **marks} for i, e in enumerate((entry, entry | {"type": "lore"}))]
    kind = "fixture string, pos long, id string, type string, title string, body string, raw string, session_id string, artifacts array<string>, excerpt_sha256 string, judge_error string, " + ", ".join(f"{c} boolean" for c in marks)
    got = evaluate.fixture_records(spark.createDataFrame(rows, kind), spark.createDataFrame([], "fixture string, pos long, title string")).orderBy("pos").collect()
    assert [x.valid for x in got] == [True, False]
