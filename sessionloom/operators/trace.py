"""A trace: a session's tables, made from any transcript, redacted as a whole before a model sees it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.globs import denied
from sessionloom.functions.redaction import ENTROPY, redactor
from sessionloom.operators import normalize


@dataclass(frozen=True)
class Trace:
    """sessions (session_id, harness, started_at, ended_at, commit), turns (session_id, idx, role, content), results
    (session_id, idx, pos, name, is_error, output), errors (session_id, ord, error), diffs (session_id, ord, file, patch)."""

    sessions: DataFrame
    turns: DataFrame
    results: DataFrame
    errors: DataFrame
    diffs: DataFrame

    def turn_rows(self) -> DataFrame:
        """Turns with their results, whether one failed, and the first failed result's output or else name."""
        by = self.results.groupBy("session_id", "idx").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "is_error", "output"))).alias("results"))
        rows = self.turns.join(by, ["session_id", "idx"], "left")
        failed = F.filter("results", lambda r: r["is_error"])
        first = F.get(failed, F.lit(0))
        return rows.withColumn("is_error", F.coalesce(F.size(failed) > 0, F.lit(False))).withColumn("signal", F.coalesce(first["output"], first["name"])).withColumn("has_result", F.col("results").isNotNull())

    def outcomes(self) -> DataFrame:
        """(session_id, outcome): that of the last turn with a tool result."""
        return normalize.outcomes(self.turn_rows())

    def error_signals(self) -> DataFrame:
        """(session_id, ord, error): session errors, then failed results in order; without output `<name> failed`."""
        own = self.errors.select("session_id", F.struct(F.lit(0).alias("k"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), "error")
        bad = self.results.filter("is_error").select("session_id", F.struct(F.lit(1).alias("k"), F.col("idx").cast("long").alias("a"), F.col("pos").cast("long").alias("b")).alias("ord"), F.coalesce("output", F.concat("name", F.lit(" failed"))).alias("error"))
        return own.unionByName(bad)


def _sessions(bounds: DataFrame, harness: str) -> DataFrame:
    return bounds.select(F.col("session").alias("session_id"), F.lit(harness).alias("harness"), "started_at", "ended_at", F.lit(None).cast("string").alias("commit"))


def of_jsonl(records: DataFrame, harness: str, now: Column | None = None) -> Trace:
    """The trace of records of one-object-per-line transcripts (normalize.jsonl_records)."""
    assigned = normalize.assigned_turns(records)
    results = normalize.tool_results(assigned)
    at = F.row_number().over(normalize.Window.partitionBy("session_id", "idx").orderBy("ord", "pos")) - 1
    turns = assigned.filter("not joins").select(F.col("session").alias("session_id"), "idx", "role", "content")
    results = results.withColumnRenamed("session", "session_id").withColumn("at", at).select("session_id", "idx", F.col("at").alias("pos"), "name", "is_error", "output")
    diffs = normalize.diffs(records).select(F.col("session").alias("session_id"), F.struct(F.col("ord").alias("a"), F.col("pos").cast("long").alias("b")).alias("ord"), "file", "patch")
    none = turns.select("session_id", F.lit(0).cast("long").alias("ord"), F.lit("").alias("error")).limit(0)
    return Trace(_sessions(normalize.bounds(records, now), harness), turns, results, none, diffs)


def of_array(records: DataFrame, harness: str, now: Column | None = None) -> Trace:
    """The trace of records of whole-array transcripts (normalize.array_records): users' and assistants' records are turns,
    a record's error is one of the session, and nothing tells changed files."""
    rows = records.filter(F.col("role").isin("user", "assistant"))
    idx = F.row_number().over(normalize.Window.partitionBy("session").orderBy("ord")) - 1
    rows = rows.withColumn("idx", idx)
    turns = rows.select(F.col("session").alias("session_id"), "idx", "role", "content")
    results = rows.select(F.col("session").alias("session_id"), "idx", F.posexplode("results").alias("pos", "r")).select("session_id", "idx", "pos", "r.name", "r.is_error", "r.output")
    errors = records.filter("error is not null").select(F.col("session").alias("session_id"), F.col("ord").cast("long").alias("ord"), "error")
    diffs = turns.select("session_id", F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), F.lit("").alias("file"), F.lit("").alias("patch")).limit(0)
    return Trace(_sessions(normalize.bounds(records, now), harness), turns, results, errors, diffs)


def of_canonical(rows: DataFrame) -> Trace:
    """The trace of canonical session rows (readers.traces); output that is not a string is rendered as JSON."""
    turns = rows.select("session_id", F.posexplode("turns").alias("idx", "t"))
    results = turns.select("session_id", "idx", F.posexplode("t.tool_results").alias("pos", "r"))
    text = F.when(F.expr("schema_of_variant(r.output) = 'STRING'"), F.expr("try_variant_get(r.output, '$', 'string')")).when(F.expr("schema_of_variant(r.output) != 'VOID'"), F.to_json("r.output"))
    return Trace(
        rows.select("session_id", "harness", F.try_to_timestamp("started_at").alias("started_at"), F.try_to_timestamp("ended_at").alias("ended_at"), "commit"),
        turns.select("session_id", "idx", "t.role", "t.content"),
        results.select("session_id", "idx", "pos", "r.name", F.coalesce("r.is_error", F.lit(False)).alias("is_error"), text.alias("output")),
        rows.select("session_id", F.posexplode("errors").alias("ord", "error")).select("session_id", F.col("ord").cast("long").alias("ord"), "error"),
        rows.select("session_id", F.posexplode("diffs").alias("ord", "d")).select("session_id", F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), "d.file", "d.patch"),
    )


def redacted(trace: Trace, deny_globs: list[str] = (), patterns: list[str] = (), least_entropy: float = ENTROPY) -> Trace:
    """The trace without the changes of denied files, its contents, outputs, patches and errors redacted.

    Denied rows go before any text is read. Output that is null stays null; names, file paths and the inputs of tool
    calls are left as they are.
    """
    clean = redactor(list(patterns), least_entropy)
    to = lambda df, c: df.withColumn(c, clean(F.col(c)))
    diffs = trace.diffs.filter(~denied(F.replace("file", F.lit("\\"), F.lit("/")), list(deny_globs))) if deny_globs else trace.diffs
    return replace(trace, turns=to(trace.turns, "content"), results=to(trace.results, "output"), errors=to(trace.errors, "error"), diffs=to(diffs, "patch"))
