"""The evaluation of a suite: every fixture extracted, judged, matched with its gold entries, and reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions.schema import ENTRY
from sessionloom.operators import evaluate, extract, report, trace
from sessionloom.sources import readers, shared, store


def fixtures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(fixture, file, session_id, trace columns) and gold (fixture, pos, title, other fields) of a suite's folder.

    Fixtures are numbered from 0, by their suffix as a number, then as text. A trace without gold entries, and either
    that is malformed, is an error.
    """
    traces, gold = store.fixture_listing(spark, folder)
    if traces.isEmpty():
        raise FileNotFoundError(f"no session_trace_*.json in {folder}")
    pairs = [r.asDict() for r in readers.fixture_pairs(traces, gold).collect()]  # the files of one folder, as listed
    order = spark.createDataFrame([(i, r["file"], r["other"]) for i, r in enumerate(pairs)], "fixture long, trace_file string, gold_file string")
    name = lambda c: F.substring_index(c, "/", -1)
    rows = readers.traces(spark, [r["file"] for r in pairs]).join(order.select("fixture", name("trace_file").alias("name")), name("file") == F.col("name")).drop("name")
    known = readers.gold(spark, [r["other"] for r in pairs]).join(order.select("fixture", name("gold_file").alias("name")), name("file") == F.col("name")).drop("name", "file")
    return rows, known


def rule_candidates(rows: DataFrame, most: int) -> DataFrame:
    """The rule extractor's entries (fixture, pos, entry columns, body) over a suite: each fixture knows what those before
    it emitted."""
    own = rows.select("fixture", F.concat_ws(":", F.col("fixture").cast("string"), "session_id").alias("of"), "session_id")
    t = trace.of_canonical(rows.withColumn("real", F.col("session_id")).withColumn("session_id", F.col("fixture").cast("string")))
    found = extract.rule_candidates(t.error_signals(), t.diffs, None, None)
    found = found.join(own.select(F.col("fixture").cast("string").alias("session_id"), "fixture", F.col("session_id").alias("real")), "session_id")
    found = found.withColumn("id", extract.entry_id(F.lit("gotcha"), F.concat("real", F.lit(":"), "error"))).withColumn("suite", F.lit(0))
    kept = evaluate.emitted(found, most).drop("suite", "session_id").withColumnRenamed("real", "session_id")
    sessions = rows.select("fixture", "harness", F.try_to_timestamp("ended_at").alias("ended_at"), "commit")
    entries = extract.as_entries(kept.withColumn("tags", F.array().cast("array<string>")).withColumnRenamed("session_id", "real").withColumn("session_id", F.col("fixture")), sessions.withColumnRenamed("fixture", "session_id"))
    # the session's own id is the evidence
    entries = entries.withColumnRenamed("session_id", "fixture").join(rows.select("fixture", F.col("session_id").alias("real")), "fixture")
    entries = entries.withColumn("evidence", F.col("evidence").withField("session_id", F.col("real"))).drop("real")
    return entries.withColumn("pos", F.row_number().over(Window.partitionBy("fixture").orderBy("ord")).cast("long") - 1)


def score(entries: DataFrame, gold: DataFrame, judge: Callable[[str], dict]) -> DataFrame:
    """evaluate.fixture_records of entries (fixture, pos, entry columns, body), which are validated again and judged."""
    prompts = entries.withColumn("artifacts", F.col("evidence.artifacts")).withColumn("prompt", extract.judge_prompt())
    key = F.concat_ws("/", F.col("fixture").cast("string"), F.col("pos").cast("string"))
    verdicts = shared.written(extract.judged(prompts.select(key.alias("id"), "prompt"), judge), "verdicts")  # each is asked once
    raw = F.to_json(F.struct(*(c for c in entries.columns if c in {k.rstrip("!?") for k in ENTRY})))
    rows = entries.withColumn("raw", raw).withColumn("key", key).join(verdicts.withColumnRenamed("id", "key"), "key").drop("key")
    rows = rows.select("fixture", "pos", "id", "type", "title", "body", "raw", "evidence.session_id", "evidence.artifacts", "evidence.excerpt_sha256", *extract.CRITERIA, *(f"{c}_reason" for c in extract.CRITERIA), "judge_error")
    return evaluate.fixture_records(rows, gold)


def run(spark: SparkSession, folder: str, judge: Callable[[str], dict], path: str, most: int = 3, modes: dict | None = None) -> dict:
    """Evaluates the rule extractor over a suite's folder, writes the report, and returns its summary.

    Everything of the suite is scored at once; the report, a file for people, is put together on the driver from one row
    a candidate.
    """
    rows, gold = fixtures(spark, folder)
    rows = shared.written(rows, "suite-traces")
    gold = shared.written(gold, "suite-gold")
    records = shared.written(score(shared.written(rule_candidates(rows, most), "suite-entries"), gold, judge), "suite-records")
    summary = evaluate.metrics(evaluate.metric_counts(records, gold).first())
    every, wanted = {}, {}
    for r in records.orderBy("fixture", "pos").collect():
        scores = {"code_checked": {"evidence_backed": r.evidence_backed, "atomic": r.atomic}, "match_checked": {"non_redundant": not r.duplicate}, "judge_scored": None if r.judge_error else {c: {"pass": r[c], "reason": r[f"{c}_reason"]} for c in extract.CRITERIA}, "passed_all": r.passed}
        every.setdefault(r.fixture, []).append({"id": r.id, "type": r.type, "title": r.title, "body": r.body, "schema_valid": r.valid, "matched_gold_title": r.matched_gold_title, "duplicate": r.duplicate, "scores": scores, "judge_error": r.judge_error, "counts_toward_precision": r.counts})
    for g in gold.orderBy("fixture", "pos").collect():
        wanted.setdefault(g.fixture, []).append(g.title)
    out = []
    for r in rows.select("fixture", "file", "session_id").orderBy("fixture").collect():
        own, titles = every.get(r.fixture, []), wanted.get(r.fixture, [])
        matched = [x["matched_gold_title"] for x in own if x["matched_gold_title"] is not None]
        left = list(titles)
        for x in matched:
            left.remove(x)
        out.append({"trace": r.file.rpartition("/")[2], "session_id": r.session_id, "gold_count": len(titles), "matched_gold_titles": matched, "unmatched_gold_titles": left, "candidates": own})
    report.write_report(path, modes or {"extraction": "rules", "judge": "injected"}, summary, out)
    return summary
