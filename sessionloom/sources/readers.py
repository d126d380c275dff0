"""Readers: transcripts, traces, entries, logs, queue jobs and model responses, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.schema import TYPES
from sessionloom.functions.text import strip
from sessionloom.operators import normalize
from sessionloom.sources import shared

TRACE = "session_id string, harness string, started_at string, ended_at string, outcome string, commit string, turns array<struct<role:string,content:string,tool_calls:array<struct<name:string,input:variant>>,tool_results:array<struct<name:string,output:variant,is_error:boolean>>>>, errors array<string>, diffs array<struct<file:string,patch:string>>"
REVIEW_LOG = "ts string, candidate_id string, type string, title string, action string, reason string, session_id string, harness string, model string, edited_fields array<string>"
CAPTURE_LOG = "ts string, session_id string, reason string, enqueued boolean, error string, mode string, pid int"
JOB = "session_id string, transcript_path string, harness string, enqueued_at string, reason string, commit string"
TOMBSTONE = "id string, title string, reason string, excerpt_sha256 string"
GOLD = "title string, type string, scope array<string>, tags array<string>, confidence string, body string"
CANDIDATE = "id string, type string, title string, artifacts array<string>, scope array<string>, tags array<string>, confidence string, body string"


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def closed(raw: Column, schema: str) -> Column:
    """Whether a JSON text is an object whose keys are all in the schema; Spark's own parser lets others pass."""
    keys = F.json_object_keys(raw)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, _names(schema))))) == 0)


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, line): the lines of files of any size, which Spark splits among tasks. ord, by which lines of a file are
    sorted, is the start of the split that a line begins in, and a number that grows within it."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("ord"), F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSONL log with their order in the file (file, ord); blank and malformed lines go, and with strict those with unknown keys."""
    lines = text_lines(spark, path).filter(strip(F.col("line")) != "")
    fits = closed(F.col("line"), schema) if strict else F.json_object_keys("line").isNotNull()
    return lines.filter(fits).select("file", "ord", F.from_json("line", schema).alias("r")).filter("r is not null").select("file", "ord", "r.*")


def jsonl_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return normalize.jsonl_records(text_lines(spark, path))


def array_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return normalize.array_records(whole_files(spark, path))


#: Normalizers by the kind of transcript; more may be registered.
TRANSCRIPTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jsonl": jsonl_transcripts, "array": array_transcripts}


#: Bytes of a batch of lines that a task hands on while it reads a transcript.
READ_BYTES = 4 << 20
#: What job_texts yields: a line, a whole file, or why there is neither.
JOB_TEXT = "session_id string, file string, ord struct<block: bigint, at: bigint>, line string, why string"


def job_texts(jobs: DataFrame, whole: bool = False) -> DataFrame:
    """JOB_TEXT rows of jobs (session_id, transcript_path): each transcript's lines, or with `whole` its text as one row.

    Paths stay in the table: the executors open them, by a URI's file system or else the local one, and a transcript that
    cannot be read is a row that says why.
    """

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            at = pa.StructArray.from_arrays([pa.array([0] * len(rows), pa.int64()), pa.array(cols[2], pa.int64())], names=["block", "at"])
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), at, pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["session_id", "file", "ord", "line", "why"])

        for given in batches:
            for sid, path in zip(*(c.to_pylist() for c in given.columns), strict=True):
                try:
                    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                    with store.open_input_stream(at) as f:
                        if whole:
                            yield batch([(sid, path, 0, f.read().decode("utf-8", "replace"), None)])
                            continue
                        n, rest = 0, b""
                        while block := f.read(READ_BYTES):
                            *lines, rest = (rest + block).split(b"\n")
                            if lines:
                                yield batch([(sid, path, n + i, x.decode("utf-8", "replace"), None) for i, x in enumerate(lines)])
                            n += len(lines)
                        yield batch([(sid, path, n, rest.decode("utf-8", "replace"), None)])
                except FileNotFoundError:
                    yield batch([(sid, path, 0, None, "no such transcript")])
                except (OSError, ValueError) as e:
                    yield batch([(sid, path, 0, None, f"the transcript cannot be read: {type(e).__name__}")])

    return jobs.select("session_id", "transcript_path").mapInArrow(read, JOB_TEXT)


def transcripts(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    if kind not in TRANSCRIPTS:
        raise ValueError(f"unknown kind of transcript: {kind}")
    return TRANSCRIPTS[kind](spark, path)


def traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical session traces, with their file. A file that lacks a required field, or has an unknown or mistyped one at any depth, is an error."""
    import json

    from sessionloom.functions import schema

    def check(batches):
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                try:
                    wrong = schema.problems(json.loads(text), schema.TRACE)
                except ValueError as e:
                    wrong = [str(e)]
                if wrong:
                    raise ValueError(f"not a session trace: {file}: {'; '.join(wrong)}")
            yield pdf[["file", "value"]]

    return whole_files(spark, path).mapInPandas(check, "file string, value string").select("file", F.from_json("value", TRACE).alias("t")).select("file", "t.*")


def entries(spark: SparkSession, path: str, tolerant: bool = False, status: str | None = None) -> DataFrame:
    """Markdown entries with a YAML head, one per file, all their fields and the body; invalid ones are an error, or go if
    tolerant. A folder that is missing has none. With `status` only entries of it. file_name, type_ord and the evidence's main fields stand beside."""
    from sessionloom.sources import store

    found = any(shared.listed(spark, p) for p in ([path] if isinstance(path, str) else path))
    rows = store.validated(whole_files(spark, path) if found else spark.createDataFrame([], "file string, value string"))
    if not tolerant:
        wrong = F.raise_error(F.concat(F.lit("invalid entry "), "file", F.lit(": "), F.array_join("errors", "; ")))
        rows = rows.withColumn("entry", F.when(F.size("errors") == 0, F.col("entry")).otherwise(wrong))
    rows = rows.filter("entry is not null").select("file", "entry.*", "body")
    rows = rows.withColumns({c: F.col(f"evidence.{c}") for c in ("session_id", "excerpt_sha256", "artifacts")})
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.withColumn("file_name", F.substring_index("file", "/", -1)).withColumn("type_ord", F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")))


def typed_entries(rows: DataFrame) -> DataFrame:
    """Entries of type folders; those whose type is not their folder's go."""
    folder = F.element_at(F.split("file", "/"), -2)
    return rows.filter(F.col("type") == folder)


def routed_entries(staging: DataFrame, typed: DataFrame, rejected: DataFrame, status: str | None = None) -> DataFrame:
    """The entries of a status: staging and rejected have tables of their own, the rest is filtered, in (type, file name) order."""
    if status in ("staged", "rejected"):
        return {"staged": staging, "rejected": rejected}[status].orderBy("file_name")
    return (typed if status is None else typed.filter(F.col("status") == status)).orderBy("type_ord", "file_name")


def tombstones(spark: SparkSession, path: str) -> DataFrame:
    """Rejected candidates' tombstones; unreadable files go."""
    return whole_files(spark, path).filter(F.json_object_keys("value").isNotNull()).select("file", F.from_json("value", TOMBSTONE).alias("r")).select("file", "r.*").orderBy("file")


def gold(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gold entries: files with a list of objects, each with a title; any other file is an error."""
    v = F.try_parse_json("value")
    is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    items = F.when(is_list, F.from_json("value", f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ') for x in GOLD.split(', ')))}>>")).otherwise(F.raise_error(F.concat(F.lit("not a list of gold entries: "), F.col("file"))))
    rows = whole_files(spark, path).select("file", F.posexplode(items).alias("pos", "g")).select("file", "pos", "g.*")
    return rows.withColumn("title", F.when(strip(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.raise_error(F.lit("a gold entry has no title"))))


def response_candidates(df: DataFrame, text: str) -> DataFrame:
    """df with `candidates`: the list in a model's response, tried once more without a code fence; empty if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.col(text)), r"^```(?:json)?[ \t]*\n?", ""), r"\n?```$", "")
    shape = f"candidates array<struct<{', '.join(x.replace(' ', ':') for x in CANDIDATE.split(', '))}>>"
    chosen = F.when(F.json_object_keys(F.col(text)).isNotNull(), F.col(text)).otherwise(bare)
    return df.withColumn("candidates", F.coalesce(F.from_json(chosen, shape)["candidates"], F.from_json(F.lit('{"candidates":[]}'), shape)["candidates"]))


def response_raw(df: DataFrame, text: str) -> DataFrame:
    """df with `raw`: the JSON of each candidate in a model's response, tried once more without a code fence; empty if there is no list."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.col(text)), r"^```(?:json)?[ \t]*\n?", ""), r"\n?```$", "")
    items = lambda t: F.expr(f"try_variant_get(try_parse_json({t}), '$.candidates', 'array<variant>')")
    rows = df.withColumn("_bare", bare)
    found = F.when(F.try_parse_json(F.col(text)).isNotNull(), items(f"`{text}`")).otherwise(items("_bare"))
    return rows.withColumn("raw", F.coalesce(F.transform(found, lambda x: F.to_json(x)), F.array().cast("array<string>"))).drop("_bare")


def fixture_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (suffix, file) tables on the suffix, numbers first in order; a left row without a partner is an error."""
    joined = left.join(right.withColumnsRenamed({"file": "other"}), "suffix", "left")
    number = F.expr("try_cast(suffix as int)")
    return joined.withColumn("other", F.when(F.col("other").isNotNull(), F.col("other")).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col("file"))))).orderBy(number.asc_nulls_last(), "suffix")
