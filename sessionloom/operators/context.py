"""The context block: approved entries in scan order, by scope, within a budget."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions.globs import shell_glob, shell_regex
from sessionloom.functions.text import strip

NOTHING = "no approved entries"
#: The line above a block that is not empty.
HEADER = "# Project knowledge\n\n"


def in_scope(entries: DataFrame, path: str, scope: str = "scope") -> DataFrame:
    """Entries with a pattern that matches the path; without patterns none does. Patterns become regexes in Spark."""
    return entries.filter(F.exists(scope, lambda g: F.rlike(F.lit(path), shell_regex(g))))


def matches(column: Column, glob: str) -> Column:
    return column.rlike(shell_glob(glob))


def chunk_text(kind: str = "type", title: str = "title", body: str = "body") -> Column:
    return F.concat(F.lit("## ["), F.col(kind), F.lit("] "), F.col(title), F.lit("\n\n"), strip(F.col(body)), F.lit("\n"))


#: Characters of the shortest chunk: the marks around an empty type, title and body.
MIN_CHUNK = 9


def within_budget(rows: DataFrame, order: list, budget: int, text: str = "chunk", by: list[str] = ()) -> DataFrame:
    """The longest prefix in order whose texts make at most `budget` tokens of four characters.

    Without `by` the whole table is one sequence. Each chunk has MIN_CHUNK characters or more, so only the first
    rows that could fit at that length, taken by partial sorts, reach the one ordered window.
    """
    if not by:
        rows = rows.orderBy(*order).limit(4 * (max(budget, 0) + 1) // MIN_CHUNK + 1)
    used = F.sum(F.char_length(text).cast("long")).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.floor(F.col("used") / 4) <= budget)


def block(rows: DataFrame, order: list[str], header: str = "") -> DataFrame:
    """One row: the header and the chunks in order, joined by line ends, or the line that says there are none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "chunk"))), lambda x: x["chunk"]), "\n")
    return rows.agg(text.alias("block")).select(F.coalesce(F.concat(F.lit(header), F.nullif("block", F.lit(""))), F.lit(NOTHING)).alias("block"))


def as_list(rows: DataFrame, order: list[str]) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct("id", "type", "title").alias("e")))), lambda x: x["e"])
    return rows.agg(F.to_json(items).alias("block"))


def as_hook(rows: DataFrame, event: str = "SessionStart") -> str:
    """The hook answer for a block of one row."""
    text = rows.first()["block"]
    return json.dumps({"hookSpecificOutput": {"hookEventName": event, "additionalContext": "" if text == NOTHING else text}})


def context(approved: DataFrame, path: str | None = None, budget: int = 1500, form: str = "text") -> DataFrame | str:
    """The whole way: approved entries in (type_ord, file_name) order, by scope, within the budget, in one of three forms.

    `text` and `json` give one row with `block`; `hook` gives the hook's answer.
    """
    order = ["type_ord", "file_name"]
    rows = (approved if path is None else in_scope(approved, path)).filter("status = 'approved'").withColumn("chunk", chunk_text())
    kept = within_budget(rows, order, budget)
    if form == "json":
        return as_list(kept, order)
    done = block(kept, order, HEADER)
    return as_hook(done) if form == "hook" else done
