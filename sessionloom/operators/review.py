"""Review as set operations: a table of decisions turns the staged entries into the next state of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import strip

APPROVALS = ("approve", "approve_with_edit", "merge")
#: Columns that a decision adds to a staged entry.
DECISION = ("action", "reason", "merge_into", "target", "edited", "edited_fields")


def edited_fields(before: dict[str, Column], after: dict[str, Column], body: tuple[Column, Column] | None = None) -> Column:
    """The sorted names of fields that differ, then `body` if the stripped bodies do, as an array."""
    marks = [F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in sorted(before)]
    if body:
        marks.append(F.when(~strip(body[0]).eqNullSafe(strip(body[1])), F.lit("body")))
    return F.array_compact(F.array(*marks))


def decided(staged: DataFrame, decisions: DataFrame, approved: DataFrame) -> DataFrame:
    """Staged entries (id, type, title, body, proposed_amendment_of, any more) with action, reason, target and edited fields.

    An approved entry that is meant as an amendment has a target if that is approved now; without one it becomes an
    entry of its own. A merge needs an approved entry of the same type, a rejection a reason: without, they are an
    error. `approve_with_edit` takes the fields of the decision's `edited` struct. Undecided entries, as after a review that
    was left early, have no action: they stay staged like skipped ones, but are neither counted nor logged as such.
    """
    rows = staged.join(decisions, "id", "left")
    rows = rows.withColumn("reason", F.when((F.col("action") == "reject") & (strip(F.coalesce("reason", F.lit(""))) == ""), F.raise_error(F.lit("a rejection has no reason"))).otherwise(F.col("reason")))
    rows = _edited(rows, staged) if "edited" in decisions.columns else rows.withColumn("edited_fields", F.array().cast("array<string>"))
    wanted = F.when(F.col("action") == "merge", F.col("merge_into")).when(F.col("action").isin(*APPROVALS), F.col("proposed_amendment_of"))
    live = approved.select(F.col("id").alias("target"), F.col("type").alias("live"))
    rows = rows.withColumn("target", wanted).join(live, "target", "left")
    lost = (F.col("action") == "merge") & ~F.col("live").eqNullSafe(F.col("type"))
    target = F.when(lost, F.raise_error(F.concat(F.lit("no approved entry of the type to merge into: "), "id"))).when(F.col("live").isNotNull(), F.col("target"))
    return rows.withColumn("target", target).drop("live")


def _edited(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """The rows with their edits, and which fields these changed."""
    edits = (F.col("action") == "approve_with_edit") & F.col("edited").isNotNull()
    names = [f.name for f in rows.schema["edited"].dataType.fields if f.name in staged.columns]
    new = {n: F.when(edits & F.col(f"edited.{n}").isNotNull(), F.col(f"edited.{n}")).otherwise(F.col(n)) for n in names}
    plain = [n for n in names if n != "body"]
    changed = edited_fields({n: F.col(n) for n in plain}, {n: new[n] for n in plain}, (F.col("body"), new["body"]) if "body" in names else None)
    return rows.withColumn("edited_fields", changed).withColumns(new)


def next_trusted(rows: DataFrame, approved: DataFrame, by: str, at: Column) -> DataFrame:
    """The approved table after the decisions: new entries, and amended ones with their notes in order of id.

    New entries keep all columns that both tables have; they are approved, reviewed, and propose nothing any more.
    Amended ones keep their own columns but the body and the time of their update.
    """
    ok = rows.filter(F.col("action").isin(*APPROVALS))
    fixed = {"status": F.lit("approved"), "approved_by": F.lit(by), "approved_at": at, "review": F.struct(F.lit(by).alias("approved_by"), at.cast("string").alias("approved_at"))}
    null = ("proposed_amendment_of", "proposed_supersession_of")
    made = [fixed.get(c, F.lit(None) if c in null or c not in rows.columns else F.col(c)) for c in approved.columns]
    made = [at if c == "updated" and c not in rows.columns else x for c, x in zip(approved.columns, made, strict=True)]
    fresh = ok.filter("target is null").select(*(x.cast(approved.schema[c].dataType).alias(c) for c, x in zip(approved.columns, made, strict=True)))
    note = F.concat(F.lit("\n\n---\n\n## Amendment ("), F.date_format(at, "yyyy-MM-dd"), F.lit(f", approved by {by})\n\n"), strip(F.col("body")), F.lit("\n"))
    notes = ok.filter("target is not null").groupBy(F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", note.alias("note")))), lambda x: x["note"]).alias("notes"))
    # what is appended to is cut by its line ends each time, as if the notes came one after the other
    added = F.aggregate("notes", F.coalesce("body", F.lit("")), lambda acc, x: F.concat(F.regexp_replace(acc, r"\n+\z", ""), x))
    amended = F.col("notes").isNotNull()
    mine = {"body": F.when(amended, added).otherwise(F.col("body")), "updated": F.when(amended, at.cast(approved.schema["updated"].dataType)).otherwise(F.col("updated"))}
    kept = approved.join(notes, "id", "left").select(*(mine[c].alias(c) if c in mine else F.col(c) for c in approved.columns))
    return kept.unionByName(fresh)


def next_staged(rows: DataFrame) -> DataFrame:
    """What is still staged: skipped and undecided entries, unchanged."""
    return rows.filter("action is null or action = 'skip'").drop(*DECISION)


def next_tombstones(rows: DataFrame) -> DataFrame:
    own = F.col("excerpt_sha256") if "excerpt_sha256" in rows.columns else F.col("evidence.excerpt_sha256")
    return rows.filter("action = 'reject'").select("id", "title", strip(F.col("reason")).alias("reason"), own.alias("excerpt_sha256"))


def log_rows(rows: DataFrame, at: Column) -> DataFrame:
    """The log's rows, one for each decision; a merge says into what, an edit which fields it changed."""
    rows = rows.filter("action is not null")
    reason = F.when(F.col("action") == "merge", F.concat(F.lit("merged into "), "target")).otherwise(F.col("reason"))
    of = lambda c: F.col(f"evidence.{c}") if "evidence" in rows.columns else F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(at.alias("ts"), F.col("id").alias("candidate_id"), "type", "title", "action", reason.alias("reason"), of("session_id").alias("session_id"), of("harness").alias("harness"), F.lit(None).cast("string").alias("model"), "edited_fields")


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many were approved in any way, rejected, skipped by a decision, and still wait, skipped or undecided."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return rows.agg(n(*APPROVALS).alias("approved"), n("reject").alias("rejected"), n("skip").alias("skipped"), F.count_if(F.coalesce("action", F.lit("skip")) == "skip").alias("remaining"))
