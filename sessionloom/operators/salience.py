"""Salient spans of a session's turns, and their excerpt.

Turns are rows (session_id, idx, role, content, is_error, signal): is_error says whether a tool result of the turn
failed, signal is the first failed result's text. Every window is partitioned by session, so one shuffle serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases that mark a second try or a step back, in the order in which they are looked for (fixed values).
RETRY_PHRASES = ("let me try again", "let's try again", "trying again", "i'll retry", "let me retry")
REVERSAL_PHRASES = ("that didn't work", "that did not work", "reverting", "let me revert", "rolling back", "undo that", "let me undo")
#: Patterns of failing and passing tests, and the longest span from one to the other (fixed values).
FAIL_PATTERN, PASS_PATTERN, MAX_TRANSITION = r"(?i)\bFAILED\b[:\s]+(\S+)", r"(?i)\bPASSED\b[:\s]+(\S+)", 6

SPAN = ("session_id", "start", "end", "reason", "signal", "ord")


def find_phrase(text: Column, phrases) -> Column:
    """The first phrase of the list that the text holds, as the text spells it; null if none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for p in reversed(list(phrases)):
        at = F.locate(p, low)
        out = F.when(at > 0, F.substring(text, at, F.lit(len(p)))).otherwise(out)
    return out


def error_spans(turns: DataFrame) -> DataFrame:
    """Each failed turn with one turn of context on both sides."""
    last = F.max("idx").over(Window.partitionBy("session_id"))
    rows = turns.withColumn("last", last).filter("is_error")
    return rows.select("session_id", F.greatest(F.col("idx") - 1, F.lit(0)).alias("start"), F.least(F.col("idx") + 1, F.col("last")).alias("end"), F.lit("error").alias("reason"), "signal", F.col("idx").cast("long").alias("ord"))


def phrase_spans(turns: DataFrame, retry=RETRY_PHRASES, reversal=REVERSAL_PHRASES) -> DataFrame:
    """Turns whose content has a retry phrase, else a reversal phrase."""
    rows = turns.withColumn("retry", find_phrase(F.col("content"), retry)).withColumn("reversal", find_phrase(F.col("content"), reversal))
    rows = rows.filter(F.col("retry").isNotNull() | F.col("reversal").isNotNull())
    reason = F.when(F.col("retry").isNotNull(), "retry").otherwise("reversal")
    return rows.select("session_id", F.col("idx").alias("start"), F.col("idx").alias("end"), reason.alias("reason"), F.coalesce("retry", "reversal").alias("signal"), (F.col("idx") + (1 << 32)).alias("ord"))


def test_events(turns: DataFrame, text: str = "content") -> DataFrame:
    """(session_id, idx, test, kind, pos): every FAILED (kind 0) and PASSED (kind 1) mention of a turn's text."""
    found = lambda p: F.regexp_extract_all(F.col(text), F.lit("(?U)" + p), F.lit(1))
    events = None
    for kind, p in enumerate((FAIL_PATTERN, PASS_PATTERN)):
        rows = turns.select("session_id", "idx", F.posexplode(found(p)).alias("pos", "test"), F.lit(kind).alias("kind"))
        events = rows if events is None else events.unionByName(rows)
    return events


def transition_spans(events: DataFrame, longest: int = MAX_TRANSITION) -> DataFrame:
    """From the first failure of a test since its last pass to the next pass, if that is near enough.

    A pass ends the group of events that led to it, so (session, test, passes before) names each candidate span.
    """
    order = Window.partitionBy("session_id", "test").orderBy("idx", "kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("grp", F.coalesce(F.sum("kind").over(order), F.lit(0)))
    spans = rows.groupBy("session_id", "test", "grp").agg(F.min(F.when(F.col("kind") == 0, F.col("idx"))).alias("start"), F.max(F.when(F.col("kind") == 1, F.struct("idx", "pos"))).alias("done"))
    spans = spans.filter(F.col("start").isNotNull() & F.col("done").isNotNull() & (F.col("done.idx") - F.col("start") + 1 <= longest))
    return spans.select("session_id", "start", F.col("done.idx").alias("end"), F.lit("test_transition").alias("reason"), F.col("test").alias("signal"), ((F.col("done.idx") * (1 << 20)) + F.col("done.pos") + (1 << 50)).alias("ord"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Merges spans that share a turn; neighbours do not merge. The first span lends reason and signal."""
    order = Window.partitionBy("session_id").orderBy("start", "end", "ord")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("start", "end", "ord", "reason", "signal")
    merged = rows.groupBy("session_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(first).alias("first"))
    return merged.select("session_id", "start", "end", "first.reason", "first.signal", "first.ord")


def turn_text(results: str = "results") -> Column:
    """A turn's content and every tool result's output that is not null, joined by line ends."""
    return F.concat_ws("\n", "content", F.transform(results, lambda r: r["output"]))


def salient_spans(turns: DataFrame, events: DataFrame | None = None, longest: int = MAX_TRANSITION, retry=RETRY_PHRASES, reversal=REVERSAL_PHRASES) -> DataFrame:
    """All spans worth reading, merged. Tests are looked for in content and tool results, phrases in content alone."""
    if events is None:
        events = test_events(turns.withColumn("all_text", turn_text()), "all_text") if "results" in turns.columns else test_events(turns)
    raw = error_spans(turns).unionByName(phrase_spans(turns, retry, reversal)).unionByName(transition_spans(events, longest))
    return merge_spans(raw)


def reflectable(turns: DataFrame, min_turns: int, errors: DataFrame | None = None, retry=RETRY_PHRASES, reversal=REVERSAL_PHRASES) -> DataFrame:
    """Sessions long enough that hold an error, a failed result or a phrase; a test transition alone does not count."""
    phrase = find_phrase(F.col("content"), (*retry, *reversal)).isNotNull()
    by = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bool_or(F.col("is_error") | F.coalesce(phrase, F.lit(False))).alias("signal"))
    if errors is not None:
        by = by.join(errors.select("session_id").distinct().withColumn("failed", F.lit(True)), "session_id", "left").withColumn("signal", F.col("signal") | F.coalesce("failed", F.lit(False))).drop("failed")
    return by.filter(F.col("signal") & (F.col("n_turns") >= min_turns)).select("session_id", "n_turns")


def gaps(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, at, omitted): turns left out before, between and after merged spans; `at` is the first turn of the gap."""
    order = Window.partitionBy("session_id").orderBy("start")
    inner = spans.withColumn("at", F.coalesce(F.lag("end").over(order) + 1, F.lit(0))).select("session_id", "at", (F.col("start") - F.col("at")).alias("omitted"))
    total = turns.groupBy("session_id").agg((F.max("idx") + 1).alias("n"))
    tail = spans.groupBy("session_id").agg((F.max("end") + 1).alias("at")).join(total, "session_id").select("session_id", "at", (F.col("n") - F.col("at")).alias("omitted"))
    return inner.unionByName(tail).filter("omitted > 0")


def excerpts(spans: DataFrame, turns: DataFrame, lines: Column, errors: DataFrame | None = None) -> DataFrame:
    """(session_id, excerpt): the spans' turns in order, gaps marked, session errors before them.

    `lines` renders a turn. A turn joins the spans by session and lies in one at most, as merged spans are disjoint.
    """
    held = turns.join(spans.select("session_id", "start", "end"), "session_id").filter(F.col("idx").between(F.col("start"), F.col("end")))
    pieces = held.select("session_id", F.col("idx").alias("at"), lines.alias("piece"))
    marks = gaps(spans, turns).select("session_id", "at", F.format_string("[... %d turns omitted ...]", "omitted").alias("piece"))
    body = pieces.unionByName(marks).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "\n").alias("body"))
    if errors is None:
        return body.select("session_id", F.col("body").alias("excerpt"))
    block = errors.groupBy("session_id").agg(F.concat(F.lit("## Session-level errors\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: F.concat(F.lit("- "), x["error"])), "\n")).alias("block"))
    return body.join(block, "session_id", "full").select("session_id", F.concat_ws("\n\n", "block", F.nullif("body", F.lit(""))).alias("excerpt"))


def render_turn(results: str | None = None) -> Column:
    """`[idx] role: content`, and a line for each tool result if a column holds them (name, is_error, output)."""
    head = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("content"))
    if results is None:
        return head
    line = lambda r: F.concat(F.lit("    tool_result("), r["name"], F.when(r["is_error"], ", error").otherwise(", ok"), F.lit("): "), F.coalesce(r["output"], F.lit("None")))
    return F.concat_ws("\n", head, F.array_join(F.transform(F.col(results), line), "\n"))
