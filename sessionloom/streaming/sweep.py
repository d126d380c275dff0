"""The queue sweep: a stream over job files, drained once, with dead letters instead of lost jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.sources.readers import JOB
from sessionloom.sources.shared import deleted, listed, shared_folder, written


#: Job files of one batch; batches after which the sessions' latest jobs are written anew as one table.
BATCH_FILES, COMPACT = 10_000, 16


def _latest(spark: SparkSession, state: str, k: int) -> DataFrame | None:
    """(session_id, known): the latest job of every session of the batches before k."""
    if not any(int(x.rpartition("=")[2]) < k for x in listed(spark, f"{state}-sessions/batch=*")):
        return None
    rows = spark.read.schema("session_id string, enqueued_at string, batch long").parquet(f"{state}-sessions").filter(F.col("batch") < k)
    return rows.groupBy("session_id").agg(F.max("enqueued_at").alias("known"))


def _remember(spark: SparkSession, state: str, k: int, good: DataFrame) -> None:
    """Writes the batch's sessions; now and then all that is known, after which earlier batches go."""
    rows = good.select("session_id", F.coalesce("enqueued_at", F.lit("")).alias("enqueued_at"))
    known = _latest(spark, state, k) if k % COMPACT == COMPACT - 1 else None
    if known is not None:
        rows = rows.unionByName(known.select("session_id", F.col("known").alias("enqueued_at"))).groupBy("session_id").agg(F.max("enqueued_at").alias("enqueued_at"))
    rows.write.mode("overwrite").parquet(f"{state}-sessions/batch={k}")
    if known is not None:
        for x in listed(spark, f"{state}-sessions/batch=*"):
            if int(x.rpartition("=")[2]) < k:
                deleted(spark, x)


def sweep(spark: SparkSession, queue: str, state: str, handle: Callable[[DataFrame, int], None], dead: str, glob: str = "*.json", whole: bool = True, batch_files: int = BATCH_FILES) -> int:
    """Drains the job files of `queue` that no earlier sweep with this `state` has seen; returns how many were handled.

    `handle` gets good jobs, the latest of each session, in batches of at most batch_files files; it must be idempotent
    per batch id. The latest job of each session is kept beside the state: an older one that comes later, in whatever
    batch or sweep, is not handled. Jobs that are not JSON or lack a session, a plain-name session id, or a transcript path
    are appended to `dead` with the reason. A file is one job, or one in each line if not `whole`.
    """
    handled = 0

    def batch(df: DataFrame, k: int) -> None:
        nonlocal handled
        rows = df.withColumn("job", F.from_json("value", JOB))
        sid, path = F.col("job.session_id"), F.col("job.transcript_path")
        why = F.when(F.json_object_keys("value").isNull(), "not a JSON object").when(F.coalesce(sid, F.lit("")) == "", "no session").when(sid.rlike(r"[/\\]|^\.{1,2}$"), "the session id is a path").when(F.coalesce(path, F.lit("")) == "", "no transcript path")
        rows = rows.withColumn("why", why).persist()
        try:
            rows.filter("why is not null").select("value", "why", F.lit(k).alias("batch")).write.mode("append").json(dead)
            good = rows.filter("why is null").select("job.*").groupBy("session_id").agg(F.max_by(F.struct(*[c.split(" ")[0] for c in JOB.split(", ") if not c.startswith("session_id")]), F.coalesce("enqueued_at", F.lit(""))).alias("j")).select("session_id", "j.*")
            if (known := _latest(spark, state, k)) is not None:
                good = good.join(known, "session_id", "left").filter(F.col("known").isNull() | (F.coalesce("enqueued_at", F.lit("")) >= F.col("known"))).drop("known")
            good = written(good, "jobs")
            handle(good, k)
            _remember(spark, state, k, good)
            handled += good.count()
        finally:
            rows.unpersist()

    source = spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", batch_files).text(queue, wholetext=whole).filter("not endswith(input_file_name(), '.transcript.json') and value != ''")
    stream = source.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
    return handled


def reflected(spark: SparkSession, extract: Callable, write: Callable[[DataFrame, int], None], dead: str, now=None) -> Callable[[DataFrame, int], None]:
    """A handler for sweep: reads the jobs' transcripts, extracts from their traces, and writes what comes of it.

    `extract` is given a Trace and returns entries. Jobs stay a table: executors read the transcripts by path. A job
    whose transcript is missing, unreadable or of an unknown kind goes to `dead`; it does not stop the others. The
    commit that was recorded at capture becomes the session's.
    """
    from sessionloom.operators import normalize, trace
    from sessionloom.sources.readers import TRANSCRIPTS, job_texts

    made = {"jsonl": (False, normalize.jsonl_records, trace.of_jsonl), "array": (True, lambda rows: normalize.array_records(rows.withColumnRenamed("line", "value")), trace.of_array)}

    def handle(jobs: DataFrame, k: int) -> None:
        lost = lambda rows: rows.select(F.col("session_id").alias("value"), "why", F.lit(k).alias("batch")).write.mode("append").json(dead)
        jobs = jobs.withColumn("kind", F.coalesce("harness", F.lit("jsonl")))
        kinds = {r[0]: r[1] for r in jobs.groupBy(F.when(F.col("kind").isin(*TRANSCRIPTS), F.col("kind"))).count().collect()}  # a row for each known kind
        if None in kinds:
            lost(jobs.filter(~F.col("kind").isin(*TRANSCRIPTS)).withColumn("why", F.concat(F.lit("unknown kind of transcript: "), "kind")))
        out = None
        for kind, (whole, records, of) in made.items():
            if kind in kinds:
                own = jobs.filter(F.col("kind") == kind)
                read = written(job_texts(own, whole), "transcripts")
                lost(read.filter("why is not null"))
                t = of(records(read.filter("why is null")), kind, now)
                t = trace.replace(t, sessions=t.sessions.drop("commit").join(own.select("session_id", "commit"), "session_id", "left"))
                out = extract(t) if out is None else out.unionByName(extract(t))
        if out is not None:
            write(out, k)

    return handle


def drain_table(spark: SparkSession, jobs: DataFrame) -> DataFrame:
    """Writes jobs to a queue, sweeps it, and returns (session_id, transcript_path, outcome) of every job."""
    queue, state, dead, done = (shared_folder(spark, n) for n in ("queue", "state", "dead", "done"))
    jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.text(queue)

    def keep(df: DataFrame, k: int) -> None:
        df.select("session_id", "transcript_path").write.mode("overwrite").parquet(f"{done}/batch={k}")

    sweep(spark, queue, state, keep, dead, "*.txt", whole=False)
    good = spark.read.schema("session_id string, transcript_path string, batch int").parquet(done).select("session_id", "transcript_path", F.lit("handled").alias("outcome"))
    bad = spark.read.schema("value string, why string, batch int").json(dead)
    return good.unionByName(bad.select(F.get_json_object("value", "$.session_id").alias("session_id"), F.lit(None).cast("string").alias("transcript_path"), F.col("why").alias("outcome")))


def drained_sessions(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """(sweep, session_id, transcript_path) of the jobs that sweeps of one queue handle, when the jobs of each table arrive
    after the sweep before."""
    queue, state, dead, done = (shared_folder(spark, n) for n in ("queue", "state", "dead", "done"))
    for n, jobs in enumerate(batches):
        jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.mode("append").text(queue)
        keep = lambda df, k, n=n: df.select("session_id", "transcript_path").write.mode("overwrite").parquet(f"{done}/sweep={n}/batch={k}")
        sweep(spark, queue, state, keep, dead, "*.txt", whole=False)
    return spark.read.schema("session_id string, transcript_path string, sweep int, batch int").parquet(done).select("sweep", "session_id", "transcript_path")
