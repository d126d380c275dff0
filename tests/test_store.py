import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import schema, similarity, text
from sessionloom.functions.globs import shell_glob, shell_regex
from sessionloom.operators import context, curate, evaluate, extract, report, review, salience, stats, trace
from sessionloom.sources import readers, store
from sessionloom.streaming.sweep import reflected, sweep

NOW = "2024-01-02T03:04:05.000000Z"


def entry(i="fact-abcd12", **more):
    return {"id": i, "type": "fact", "title": "A title of this", "status": "staged", "spec_version": "0.1.0", "scope": ["a/**"], "tags": ["t"], "confidence": "low", "evidence": {"harness": "h", "session_id": "s", "captured_at": NOW, "artifacts": ["a/b"]}, "created": NOW, "updated": NOW} | more


@pytest.mark.parametrize(("change", "want"), [
    ({}, []), ({"x": 1}, ["x: unknown field"]), ({"type": "lore"}, ["type: not one of strategy, gotcha, fact"]), ({"scope": "a"}, ["scope: not a list"]), ({"tags": ["a", 1]}, ["tags.1: not of kind str"]),
    ({"created": "soon"}, ["created: not of kind time"]), ({"evidence": {"harness": "h", "z": 0}}, ["evidence.z: unknown field", "evidence.captured_at: missing"]), ({"review": None}, []), ({"usage": {"injected": True}}, ["usage.injected: not of kind int"]), ({"title": None}, ["title: not of kind str"]),
])
def test_every_wrong_field_is_named(change, want):
    assert schema.problems(entry() | change, schema.ENTRY) == want


def test_json_schemas_are_closed():
    s = schema.response_schema()
    item = s["properties"]["candidates"]["items"]
    assert s["required"] == ["candidates"] and item["additionalProperties"] is False and item["required"] == ["id", "type", "title", "confidence", "body"]
    assert schema.json_schema(schema.ENTRY)["properties"]["review"]["anyOf"][1] == {"type": "null"} and schema.warnings({"scope": []}) and not schema.warnings(entry())


def test_markdown_round_trip():
    e, body = entry(), "## Head\n\n---\ntext é"
    back, b = store.parse_markdown(store.render_markdown(e, body))
    assert b == body and {k: v for k, v in back.items() if v != []} == e
    for bad, why in (("no head", "no head"), ("---\n: [\n---\n", "not YAML"), ("---\nid: 3\n---\n", "id: not of kind str; type: missing")):
        with pytest.raises(ValueError, match=why):
            store.parse_markdown(bad)


def rows_of(spark, *entries):
    made = [json.dumps(e | {"body": f"body of {e['id']}"}) for e in entries]
    kind = store.ENTRY_COLUMNS + ", body string"
    return spark.createDataFrame([(x,) for x in made], "j string").select(F.from_json("j", kind).alias("e")).select("e.*")


def test_store_is_written_listed_and_read(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.init_store(root)
    with pytest.raises(FileExistsError):
        store.init_store(root)
    assert (tmp_path / ".gitignore").read_text() == "store/queue/\nstore/traces/\n" and store.merge_lines(tmp_path / ".gitignore", ["store/queue/", "x"]) == 1
    assert store.entry_listing(spark, root).count() == 0 and store.health(root)[0][0] == "PASS"
    staged, good = rows_of(spark, entry()), rows_of(spark, entry("gotcha-ffff00", type="gotcha", status="approved", scope=[]), entry("fact-0000ff", status="approved"))
    path = store.write_entries(staged, root).first()["path"]
    assert path == f"{root}/staging/2024-01-02-a-title-of-this-abcd.md"
    store.write_entries(staged.withColumn("body", F.lit("newer")), root)  # same path: replaced
    store.write_entries(good, root, trusted=True)
    with pytest.raises(Exception, match="not staged: (gotcha|fact-0000ff)"):  # both are refused; the first task to fail names its own
        store.write_entries(good, root)
    with pytest.raises(Exception, match="not approved or superseded or archived: fact"):
        store.write_entries(staged, root, trusted=True)
    Path(root, "entries/fact/bad.md").write_text("---\nid: x\n---\n")
    checked = store.validated(store.entry_listing(spark, root)).collect()
    assert [Path(r.file).parent.name for r in checked] == ["gotcha", "fact", "fact", "staging"] and [len(r.errors) > 0 for r in checked] == [False, False, True, False]
    assert [len(r.warnings) for r in checked] == [1, 0, 0, 0]
    back = readers.entries(spark, f"{root}/staging/*.md").first()
    assert back.body == "newer" and back.evidence.artifacts == ["a/b"] and back.session_id == "s"
    assert not list(Path(root).rglob("*.tmp")) and readers.entries(spark, f"{root}/entries/fact/*.md", tolerant=True, status="approved").count() == 1


def test_context_in_three_forms(spark, tmp_path):
    rows = rows_of(spark, entry("a", status="approved", scope=["src/[!b]*", "x/[oops"]), entry("b", status="approved", scope=[]), entry("c", status="staged")).withColumn("type_ord", F.lit(3)).withColumn("file_name", F.col("id"))
    assert context.context(rows).first()["block"] == "# Project knowledge\n\n## [fact] A title of this\n\nbody of a\n\n## [fact] A title of this\n\nbody of b\n"
    assert json.loads(context.context(rows, "src/a/b.py", form="json").first()["block"]) == [{"id": "a", "type": "fact", "title": "A title of this"}]
    assert context.context(rows, "src/b").first()["block"] == context.NOTHING and json.loads(context.context(rows, "src/b", form="hook"))["hookSpecificOutput"]["additionalContext"] == ""


GLOBS = ["*", "a?c", "src/*", "[!a]b", "[a-c]*", "[]x]y", "x/[oops", "[c-a]z", "a.b+(c)", "[^a]", "[a&&b]", "é[é-ü]", "", "[!]]", "[a\\]", "\\*", "{a,b}", "[z-a]", "[!z-a]"]
PATHS = ["", "a", "abc", "a\nc", "src/a/b", "cb", "ab", "]y", "xy", "x/[oops", "az", "cz", "a.b+(c)", "^", "b", "&", "éü", "\\x", "{a,b}", "]", "\\"]


def test_shell_globs_equal_the_shell(spark):
    import fnmatch

    df = spark.createDataFrame([(g, p) for g in GLOBS for p in PATHS], "g string, p string")
    for r in df.select("g", "p", F.rlike("p", shell_regex(F.col("g"))).alias("got")).collect():
        assert r.got == fnmatch.fnmatchcase(r.p, r.g), (r.g, r.p)
    for r in df.select("g", "p", F.coalesce(*(F.when(F.col("g") == g, F.rlike("p", F.lit(shell_glob(g)))) for g in GLOBS)).alias("got")).collect():
        assert r.got == fnmatch.fnmatchcase(r.p, r.g), (r.g, r.p)


def test_configuration_and_gate(tmp_path):
    at = tmp_path / "config.toml"
    root = str(tmp_path)
    assert store.approval_problem(root) == "there is no config.toml" and store.load_config(root) == {} and store.extractor_name({}) == "mock"
    for body, why in (("x = [", "cannot be read"), ("a = 1", "is not set"), ("[review]\nrequire_human_approval = false", "is false"), ("[review]\nrequire_human_approval = 1", "not the boolean true")):
        at.write_text(body)
        assert why in store.approval_problem(root)
        with pytest.raises(store.ApprovalRequired):
            store.require_approval(root)
    at.write_text("[review]\nrequire_human_approval = true\n[provider]\nname = 'm'\nmodel = 'big'\n[redaction]\npatterns = ['x']\n[reflect]\nmin_session_turns = 2")
    store.require_approval(root)

    def client(p):
        return p

    client.requires = ("model",)
    name, got, settings = store.extractor_settings(store.load_config(root), {"m": client}, {})
    assert (name, got) == ("m", client) and settings == {"deny_globs": [], "patterns": ["x"], "min_turns": 2, "model": "big"}
    client.requires, client.needs_env = ("base_url",), ()
    with pytest.raises(store.ExtractorUnavailable, match="base_url"):
        store.extractor_settings(store.load_config(root), {"m": client}, {})
    client.requires, client.needs_env = (), ("KEY",)
    with pytest.raises(store.ExtractorUnavailable, match="KEY"):
        store.extractor_settings(store.load_config(root), {"m": client}, {})
    with pytest.raises(store.ExtractorUnavailable, match="unknown extractor"):
        store.extractor_settings({"provider": {"name": "q"}}, {"m": client})


def test_capture_edge(tmp_path):
    root = f"{tmp_path}/store"
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    assert store.git_head(str(tmp_path)) is None
    (tmp_path / ".git/packed-refs").write_text("# x\nabc refs/heads/main\n")
    event = {"session_id": "s1", "cwd": str(tmp_path), "transcript_path": "/t", "reason": "exit"}
    path = store.enqueue(event, root, "jsonl", "1")
    assert json.loads(Path(path).read_text()) == {"session_id": "s1", "transcript_path": "/t", "harness": "jsonl", "enqueued_at": "1", "reason": "exit", "commit": "abc"}
    (tmp_path / ".git/refs/heads/main").write_text("def\n")
    assert store.enqueue(event, root, "jsonl", "2", mode="hook") == path and json.loads(Path(path).read_text())["commit"] == "def"
    assert store.enqueue(event | {"session_id": "../x"}, root, "jsonl", "3") is None and store.enqueue({}, root, "jsonl", "4") is None
    log = [json.loads(x) for x in Path(root, "capture-log.jsonl").read_text().splitlines()]
    assert [(x["ts"], x["enqueued"], x.get("error")) for x in log] == [("1", True, None), ("2", True, None), ("3", False, "unsafe session_id")]
    assert not store.trace_hook(root, event, "5", False) and not Path(root, "hook-trace.jsonl").exists()
    assert store.trace_hook(root, event, "5", True) and json.loads(Path(root, "hook-trace.jsonl").read_text())["event"] == event
    assert store.hook_event("") == store.hook_event("[") == store.hook_event("[1]") == {} and store.hook_event('{"a":1}') == {"a": 1}


def test_transcript_listing_has_three_errors(tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing to count"):
        store.session_transcripts(f"{tmp_path}/none", "/a/b")
    (tmp_path / "-other").mkdir()
    with pytest.raises(FileNotFoundError, match="there are -other"):
        store.session_transcripts(str(tmp_path), "/a/b")
    (tmp_path / "-a-b").mkdir()
    with pytest.raises(FileNotFoundError, match="has no transcripts"):
        store.session_transcripts(str(tmp_path), "/a/b")
    (tmp_path / "-a-b/x.jsonl").touch()
    assert [p.name for p in store.session_transcripts(str(tmp_path), "/a/b")] == ["x.jsonl"]


def test_fixtures_are_paired_in_order(spark, tmp_path):
    for n in ("10", "2", "x"):
        (tmp_path / f"session_trace_{n}.json").write_text("{}")
        (tmp_path / f"gold_{n}.json").write_text("[]")
    assert [r.suffix for r in readers.fixture_pairs(*store.fixture_listing(spark, str(tmp_path))).collect()] == ["2", "10", "x"]
    (tmp_path / "gold_x.json").unlink()
    with pytest.raises(Exception, match="no partner"):
        readers.fixture_pairs(*store.fixture_listing(spark, str(tmp_path))).collect()
    (tmp_path / "gold_2.json").write_text("{}")
    with pytest.raises(Exception, match="not a list of gold entries"):
        readers.gold(spark, f"{tmp_path}/gold_2.json").collect()


KEY = "sk-ant-" + "aB3xK9qLmZ7wR2tYv5uP8sD1"


def canonical(tmp_path, **more):
    t = {"session_id": "S", "harness": "h", "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:05:00Z", "outcome": "ok", "commit": "c0", "turns": [
        {"role": "user", "content": f"use {KEY}"},
        {"role": "assistant", "content": "run", "tool_calls": [{"name": "bash", "input": {"k": KEY}}], "tool_results": [{"name": "bash", "output": f"FAILED test_a.py {KEY}", "is_error": True}, {"name": "ls", "output": None}]},
        {"role": "assistant", "content": "again", "tool_results": [{"name": "bash", "output": {"n": 1}}, {"name": "bash", "output": "PASSED test_a.py"}, {"name": "rm", "is_error": True}]},
        {"role": "user", "content": "fine"}], "errors": [f"boom in a.py {KEY}"], "diffs": [{"file": "a.py", "patch": f"+ {KEY}"}, {"file": "conf/.env", "patch": "+ x"}]} | more
    (tmp_path / "t.json").write_text(json.dumps(t))
    return t


def test_whole_traces_are_redacted(spark, tmp_path):
    canonical(tmp_path)
    t = trace.of_canonical(readers.traces(spark, str(tmp_path)))
    r = trace.redacted(t, [".env*"])
    seen = [x for df, c in ((r.turns, "content"), (r.results, "output"), (r.errors, "error"), (r.diffs, "patch")) for x in (y[c] for y in df.collect()) if x]
    assert not any(KEY in x for x in seen) and sum("[REDACTED:anthropic-key]" in x for x in seen) == 4
    assert [x.file for x in r.diffs.collect()] == ["a.py"] and {x.output for x in r.results.collect()} >= {None, '{"n":1}'}
    rows = {x.idx: x for x in r.turn_rows().collect()}
    assert rows[1].is_error and rows[1].signal.startswith("FAILED test_a.py") and rows[2].signal == "rm" and not rows[3].has_result
    assert [x.error for x in t.error_signals().orderBy("ord").collect()] == [f"boom in a.py {KEY}", f"FAILED test_a.py {KEY}", "rm failed"]
    assert t.outcomes().first()["outcome"] == "error"
    spans = salience.salient_spans(r.turn_rows().filter("idx < 3").withColumn("is_error", F.lit(False)))
    assert [(x.start, x.end, x.signal) for x in spans.collect()] == [(1, 2, "test_a.py")]  # seen in tool output


def test_rule_entries_of_a_trace(spark, tmp_path):
    canonical(tmp_path)
    rows = extract.rule_entries(trace.of_canonical(readers.traces(spark, str(tmp_path))), most=2).orderBy("ord").collect()
    assert [(r.title, r.scope, r.evidence.artifacts, r.evidence.commit, r.evidence.excerpt_sha256) for r in rows] == [(f"boom in a.py {KEY}", ["a.py"], ["a.py"], "c0", None), (f"FAILED test_a.py {KEY}", ["a.py"], ["a.py"], "c0", None)]
    assert rows[0].evidence.captured_at == "2024-01-01T00:05:00.000000Z" and not schema.problems({k: v for k, v in rows[0].asDict(True).items() if k not in ("session_id", "ord", "body", "excerpt_sha256")}, schema.ENTRY)


def test_model_entries(spark, tmp_path):
    canonical(tmp_path)
    asked = tmp_path / "asked"
    good = {"id": "mine", "type": "gotcha", "title": "T", "confidence": "low", "body": "b"}
    answer = json.dumps({"candidates": [good | {"extra": 1}, good | {"artifacts": ["invented.py"]}, good, good | {"scope": ["zz"], "body": "again"}, good | {"title": "U", "artifacts": ["a.py"], "scope": ["a.py", "q"]}, 3]})

    def client(p):
        asked.write_text(p)
        return f"```json\n{answer}\n```"

    t = trace.of_canonical(readers.traces(spark, str(tmp_path)))
    known = spark.createDataFrame([("k1", "fact", "Known")], "id string, type string, title string")
    rows = extract.model_entries(t, known, client, min_turns=3, deny_globs=[".env*"]).orderBy("ord").collect()
    assert [(r.title, r.scope, r.evidence.artifacts) for r in rows] == [("T", ["a.py"], ["a.py"]), ("U", ["a.py"], ["a.py"])]
    p = asked.read_text()
    assert KEY not in p and "- k1 [fact] Known" in p and "- a.py" in p and ".env" not in p and "## Session-level errors" in p and "tool_result(bash, error)" in p
    assert rows[0].id == "gotcha-" + __import__("hashlib").sha256(b"S:T").hexdigest()[:6] and len(rows[0].evidence.excerpt_sha256) == 64
    assert extract.model_entries(t, known, client, min_turns=9).count() == 0 and extract.model_entries(t, known, client, most=0).count() == 0


def test_invalid_candidates_say_why(spark):
    rows = spark.createDataFrame([('{"id":"a","type":"x","title":"t","confidence":"low","body":"b"}',), ("no",), ('{"id":"a","type":"fact","title":"t","confidence":"low","body":"b","tags":["q"]}',)], "raw string")
    got = store.checked_candidates(rows).collect()
    assert got[0].errors == ["type: not one of strategy, gotcha, fact"] and got[1].errors == ["<root>: not JSON"] and got[2].candidate.tags == ["q"] and got[0].candidate is None


def test_array_transcripts_become_traces(spark, tmp_path):
    tool = lambda status, **more: {"type": "tool", "tool": "bash", "state": {"status": status, "input": {}, **more}}
    data = [
        {"info": {"role": "user", "sessionID": "Q", "time": {"created": 1700000000000}}, "parts": [{"type": "text", "text": "hi"}]},
        {"info": {"role": "assistant", "error": {"name": "X"}, "time": {"created": 1700000060000}}, "parts": [tool("error", error="E"), tool("completed", output="ok"), tool("running")]},
        {"info": {"role": "system"}, "parts": []}, 3,
    ]
    (tmp_path / "g.transcript.json").write_text(json.dumps(data))
    t = trace.of_array(readers.transcripts(spark, str(tmp_path), "array"), "array")
    assert [(r.session_id, r.idx, r.role, r.content, r.is_error, r.signal) for r in t.turn_rows().orderBy("idx").collect()] == [("Q", 0, "user", "hi", False, None), ("Q", 1, "assistant", "", True, "E")]
    assert json.loads(t.errors.first().error) == {"name": "X"} and t.outcomes().first()["outcome"] == "error" and t.diffs.count() == 0
    s = t.sessions.first()
    assert (s.ended_at - s.started_at).seconds == 60


def test_sweep_extracts_and_stages(spark, tmp_path):
    q = tmp_path / "queue"
    q.mkdir()
    lines = [{"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "Edit", "input": {"file_path": "a.py", "old_string": "x", "new_string": "y"}}]}}, {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": "broken a.py", "is_error": True}]}}]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    jobs = [("s1", f"{tmp_path}/s1.jsonl", "jsonl"), ("s2", f"{tmp_path}/none.jsonl", "jsonl"), ("s3", f"{tmp_path}/s1.jsonl", "odd")]
    for sid, path, harness in jobs:
        (q / f"{sid}.json").write_text(json.dumps({"session_id": sid, "transcript_path": path, "harness": harness, "enqueued_at": "1", "commit": "c9"}, indent=2))
    out, dead = f"{tmp_path}/out", f"{tmp_path}/dead"
    handle = reflected(spark, extract.rule_entries, lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"), dead)
    assert sweep(spark, str(q), f"{tmp_path}/state", handle, dead) == 3
    rows = spark.read.parquet(out).collect()
    assert [(r.session_id, r.title, r.evidence.commit, r.scope) for r in rows] == [("s1", "broken a.py", "c9", ["a.py"])]
    assert sorted(r.why for r in spark.read.json(dead).collect()) == ["no such transcript", "unknown kind of transcript: odd"]


def test_staging_logs_every_candidate(spark):
    batch = rows_of(spark, entry("fact-1", title="Never restart workers"), entry("fact-2", title="Quite another thing"), entry("fact-3", title="Quite another things")).withColumn("seq", F.substring("id", 6, 1).cast("long")).withColumn("file_name", F.col("id")).withColumn("excerpt_sha256", F.lit(None).cast("string"))
    none = batch.withColumn("type_ord", F.lit(3)).limit(0)
    stones = spark.createDataFrame([("t", "never restart", "no", None)], readers.TOMBSTONE)
    staged, log = curate.staged_entries(rows_of(spark, entry("fact-1", title="Never restart workers"), entry("fact-2", title="Quite another thing"), entry("fact-3", title="Quite another things")), curate.outcomes(batch, none, none, stones), "m", F.lit("2024-01-01").cast("timestamp"))
    assert {r.id: r.proposed_amendment_of for r in staged.collect()} == {"fact-2": None, "fact-3": "fact-2"}
    assert {r.candidate_id: (r.action, r.reason, r.model, r.session_id) for r in log.collect()} == {"fact-1": ("gate_drop", "tombstone", "m", "s"), "fact-2": ("staged", None, "m", "s"), "fact-3": ("staged", None, "m", "s")}


def test_decisions_keep_whole_entries(spark, tmp_path):
    staged = rows_of(spark, entry("fact-1", proposed_supersession_of="z"), entry("fact-2", title="Old words"), entry("fact-3"), entry("fact-4"))
    approved = rows_of(spark, entry("fact-9", status="approved"), entry("gotcha-9", type="gotcha", status="approved"))
    edit = "struct<title:string,body:string,tags:array<string>>"
    kind = f"id string, action string, reason string, merge_into string, edited {edit}"
    at = F.lit("2024-02-03").cast("timestamp")
    decisions = spark.createDataFrame([("fact-1", "approve", None, None, None), ("fact-2", "approve_with_edit", None, None, ("New words", " body of fact-2 ", None)), ("fact-3", "merge", None, "fact-9", None)], kind)
    rows = review.decided(staged, decisions, approved)
    trusted = {r.id: r for r in review.next_trusted(rows, approved, "me", at).collect()}
    assert trusted["fact-1"].status == "approved" and trusted["fact-1"].scope == ["a/**"] and trusted["fact-1"].proposed_supersession_of is None and trusted["fact-1"].review.approved_by == "me" and trusted["fact-1"].updated == NOW
    assert trusted["fact-2"].title == "New words" and trusted["fact-9"].body == "body of fact-9\n\n---\n\n## Amendment (2024-02-03, approved by me)\n\nbody of fact-3\n" and trusted["fact-9"].status == "approved"
    log = {r.candidate_id: (r.action, r.reason, r.edited_fields, r.harness) for r in review.log_rows(rows, at).collect()}
    assert log["fact-2"] == ("approve_with_edit", None, ["title"], "h") and log["fact-3"][1] == "merged into fact-9"
    assert [r.id for r in review.next_staged(rows).collect()] == ["fact-4"] and review.next_staged(rows).columns == staged.columns
    assert tuple(review.summary(rows).first()) == (3, 0, 0, 1) and store.append_log(review.log_rows(rows, at), f"{tmp_path}/log") and readers.json_lines(spark, f"{tmp_path}/log", readers.REVIEW_LOG).count() == 3  # one is undecided
    for target in ("gotcha-9", "none", None):
        with pytest.raises(Exception, match="no approved entry of the type"):
            review.decided(staged, spark.createDataFrame([("fact-3", "merge", None, target, None)], kind), approved).collect()


def test_fixture_records_and_metrics(spark, tmp_path):
    marks = dict.fromkeys(evaluate.CRITERIA, True)
    one = lambda pos, title, body="## A\n", **more: {"fixture": "f", "pos": pos, "id": f"i{pos}", "type": "fact", "title": title, "body": body, "valid": True, "session_id": "s", "artifacts": ["a"], "excerpt_sha256": None, **marks, "judge_error": None} | more
    data = [one(0, "alpha beta gamma"), one(1, "alpha beta delta"), one(2, "quite other words", body="none"), one(3, "left over entry", judge_error="x", stable=None), one(4, "known thing here")]
    kind = "fixture string, pos long, id string, type string, title string, body string, valid boolean, session_id string, artifacts array<string>, excerpt_sha256 string, " + ", ".join(f"{c} boolean" for c in marks) + ", judge_error string"
    cand = spark.createDataFrame(data, kind)
    gold = spark.createDataFrame([("f", 0, "Alpha beta gamma"), ("f", 1, "left over entry")], "fixture string, pos long, title string")
    rows = {r.pos: r for r in evaluate.fixture_records(cand, gold, spark.createDataFrame([("Known thing",)], "title string")).collect()}
    assert [rows[i].duplicate for i in range(5)] == [False, True, False, False, True] and [rows[i].counts for i in range(5)] == [True, False, False, False, False]
    assert rows[3].matched and rows[3].evidence_backed and not rows[3].passed and not rows[2].atomic
    m = evaluate.metrics(evaluate.metric_counts(evaluate.fixture_records(cand, gold), gold).first())
    assert m["precision"] == {"rate": 0.2, "numerator": 1, "denominator": 5} and m["recall"]["rate"] == 1.0 and m["judge_errors"] == 1
    empty = evaluate.metrics(evaluate.metric_counts(evaluate.fixture_records(cand.limit(0), gold.limit(0)), gold.limit(0)).first())
    assert empty["precision"]["rate"] is None
    report.write_report(f"{tmp_path}/r/x.json", {"judge": "fixed"}, m, [])
    assert json.loads(Path(f"{tmp_path}/r/x.json").read_text())["summary"]["recall"]["numerator"] == 2


def test_report_lines(spark):
    assert report.rate_text(2, 4, "shown") == "50.0% (2/4 shown)" and report.rate_text(0, 0, "shown") == "n/a (0/0 shown)" and report.rate_text(1, 3) == "33.3% (1/3)"
    assert report.histogram_lines([("b", 2), ("a", 2), ("c", 9)]) == ["     9  c", "     2  a", "     2  b"]
    assert report.outcome_line("i", "T", "dropped", None) == "dropped i: T (matches a rejected tombstone)" and report.outcome_line("i", "T", "supersession", "x") == "staged i: T (may supersede x)" and report.outcome_line("i", "T", "new", None) == "staged i: T"
    log = spark.createDataFrame([(a,) for a in ("approve", "reject", "skip", "merge", "staged", "gate_drop")], "action string")
    lines = report.review_lines(stats.review_stats(log).first(), [("dup", 1)], [("tombstone", 1)])
    assert "approval rate          50.0% (2/4 shown)" in lines and "  excluding skipped    66.7% (2/3 decided)" in lines and "gate-drop rate         50.0% (1/2 extracted)" in lines
    assert report.review_summary(1, 2, 3, 4) == "1 approved, 2 rejected, 3 skipped, 4 remaining in staging" and report.check_line("PASS", "store", "x") == "PASS       store: x"


def test_white_space_is_stripped_as_a_whole(spark):
    row = spark.createDataFrame([("a\t\n", " a")], "x string, y string")
    assert row.select(review.edited_fields({}, {}, (F.col("x"), F.col("y")))).first()[0] == []
    assert similarity.title_pairs(spark.createDataFrame([("\t\n",)], "title string"), row.select(F.col("x").alias("title")), 0.1).count() == 0


def test_edit_previews(spark):
    f = lambda **v: spark.range(1).select(text.diff_of_edit(*(F.lit(v.get(k)).cast("string") for k in ("name", "file", "old", "new", "content")))).first()[0]
    assert f(name="Edit", file="a", old="x" * 3000, new="y") == "- " + "x" * 1998 and f(name="Edit", file="a", new="y") is None and f(name="Edit", old="x", new="y") is None
    assert f(name="Write", file="a", content="z" * 3000) == "+ " + "z" * 2000 and f(name="Write", file="a") is None and f(name="Other", file="a", content="z") is None


def test_judge_request(spark):
    row = spark.createDataFrame([("fact", "T", [], ["x", "y"], "low", ["a.py"], " b \n")], "type string, title string, scope array<string>, tags array<string>, confidence string, artifacts array<string>, body string")
    p = row.select(extract.judge_prompt()).first()[0]
    assert "scope: (none)" in p and "tags: x, y" in p and "artifacts: a.py" in p and "\n\nb\n\n" in p and all(c in p for c in extract.CRITERIA)
