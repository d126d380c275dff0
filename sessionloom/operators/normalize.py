"""Raw transcripts of two shapes into turns, tool results, changed files and session bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions.text import diff_of_edit, text_of_blocks

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,is_error:boolean,content:variant,input:variant>>"
RECORD = "session string, ord struct<block: bigint, at: bigint>, ts timestamp, role string, content string, blocks " + BLOCKS


def _string(v: Column, path: str) -> Column:
    """A variant's field if it is a string; numbers do not count as one."""
    return F.when(F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'STRING'"), F.expr(f"try_variant_get({v}, '{path}', 'string')"))


def _object(v: str, path: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'variant')")


def jsonl_records(lines: DataFrame) -> DataFrame:
    """Lines (file, ord, line) of one-object-per-line transcripts, as records.

    Blank, malformed and non-object lines go, as do those that are not a user's or assistant's message. The first
    string session id names the session, else the file's stem.
    """
    rows = lines.withColumn("v", F.try_parse_json("line")).filter(F.expr("schema_of_variant(v) like 'OBJECT%'"))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    own = F.min(F.when(_string("v", "$.sessionId").isNotNull(), F.struct("ord", _string("v", "$.sessionId").alias("id")))).over(Window.partitionBy("file"))
    rows = rows.withColumn("session", F.coalesce(own["id"], stem)).withColumn("role", _string("v", "$.type"))
    rows = rows.filter(F.col("role").isin("user", "assistant") & F.expr("schema_of_variant(try_variant_get(v, '$.message', 'variant')) like 'OBJECT%'"))
    blocks = F.expr(f"try_variant_get(v, '$.message.content', '{BLOCKS}')")
    ts = F.try_to_timestamp(_string("v", "$.timestamp"))
    return rows.select("session", "ord", ts.alias("ts"), "role", _string("v", "$.message.content").alias("content"), F.coalesce(blocks, F.array().cast(BLOCKS)).alias("blocks"))


def assigned_turns(records: DataFrame) -> DataFrame:
    """(session, ord, idx, role, content, results_only): which turn each record starts or joins.

    A user record with tool results joins the turn before it if that is an assistant's, and its text goes; otherwise
    it starts a user turn and its results go. What counts as before is the last record that was not such a one.
    """
    has = F.exists("blocks", lambda b: b["type"] == "tool_result")
    kind = F.when(F.col("role") == "assistant", "A").when(has, "R").otherwise("U")
    order = Window.partitionBy("session").orderBy("ord")
    rows = records.withColumn("kind", kind)
    prior = F.last(F.when(F.col("kind") != "R", F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("joins", (F.col("kind") == "R") & F.coalesce(prior == "A", F.lit(False)))
    idx = F.sum((~F.col("joins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    text = F.coalesce(F.col("content"), text_of_blocks(F.col("blocks")))
    return rows.select("session", "ord", "ts", idx.cast("int").alias("idx"), "joins", "role", text.alias("content"), "blocks")


def asof_name(is_use: Column, name: Column, keys: list, order: list) -> Column:
    """The name of the latest use before a row among those with its keys, else `tool`."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(is_use, name), ignorenulls=True).over(before), F.lit("tool"))


def tool_results(assigned: DataFrame) -> DataFrame:
    """(session, idx, ord, pos, name, is_error, output): results with the latest earlier name of their call id, else `tool`."""
    uses = assigned.select("session", "ord", F.posexplode("blocks").alias("pos", "b")).filter("b.type in ('tool_use', 'tool_result')")
    ident = F.coalesce("b.id", "b.tool_use_id")
    named = uses.withColumn("ident", ident).withColumn("name", asof_name(F.col("b.type") == "tool_use", F.col("b.name"), ["session", "ident"], ["ord", "pos"]))
    turn = assigned.filter("joins").select("session", "ord", "idx")
    text = F.expr("case when schema_of_variant(b.content) = 'STRING' then try_variant_get(b.content, '$', 'string') end")
    inner = F.expr("try_variant_get(b.content, '$', 'array<struct<type:string,text:string>>')")
    output = F.coalesce(text, F.nullif(text_of_blocks(inner), F.lit("")), F.to_json("b.content"))
    rows = named.filter("b.type = 'tool_result'").join(turn, ["session", "ord"])
    return rows.select("session", "idx", "ord", "pos", "name", F.coalesce("b.is_error", F.lit(False)).alias("is_error"), output.alias("output"))


def turns(assigned: DataFrame, results: DataFrame) -> DataFrame:
    """The turn table: session_id, idx, role, content, is_error, signal, results."""
    base = assigned.filter("not joins").select(F.col("session").alias("session_id"), "idx", "role", "content")
    by = results.groupBy("session", "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "name", "is_error", "output"))).alias("results"))
    joined = base.join(by.withColumnRenamed("session", "session_id"), ["session_id", "idx"], "left")
    failed = F.filter("results", lambda r: r["is_error"])
    signal = F.coalesce(F.get(failed, F.lit(0))["output"], F.get(failed, F.lit(0))["name"])
    return joined.withColumn("is_error", F.coalesce(F.size(failed) > 0, F.lit(False))).withColumn("signal", signal)


def diffs(records: DataFrame) -> DataFrame:
    """(session, ord, pos, file, patch) of edits and writes."""
    uses = records.filter("role = 'assistant'").select("session", "ord", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_use'")
    field = lambda k: F.expr(f"case when schema_of_variant(try_variant_get(b.input, '$.{k}', 'variant')) = 'STRING' then try_variant_get(b.input, '$.{k}', 'string') end")
    patch = diff_of_edit(F.col("b.name"), field("file_path"), field("old_string"), field("new_string"), field("content"))
    return uses.select("session", "ord", "pos", field("file_path").alias("file"), patch.alias("patch")).filter(F.col("patch").isNotNull())


def bounds(records: DataFrame, now: Column | None = None) -> DataFrame:
    """(session, started_at, ended_at): least and largest readable stamps, else `now`."""
    now = F.current_timestamp() if now is None else now
    return records.groupBy("session").agg(F.coalesce(F.min("ts"), now).alias("started_at"), F.coalesce(F.max("ts"), now).alias("ended_at"))


def outcomes(turn_rows: DataFrame) -> DataFrame:
    """(session_id, outcome): `error` if the last turn with a tool result has a failed one, else `completed`.

    Turns are (session_id, idx, has_result, is_error).
    """
    last = F.max_by("is_error", F.when(F.col("has_result"), F.col("idx")))
    return turn_rows.groupBy("session_id").agg(F.when(F.coalesce(last, F.lit(False)), "error").otherwise("completed").alias("outcome"))


def array_records(files: DataFrame) -> DataFrame:
    """Whole files (file, value) that hold one array of {info, parts}, as rows with role, text and tool results.

    A file that is no JSON array is an error; records without info and parts go. The first string session id names
    the session, else the stem. Columns: session, ord, ts, role, content, results (name, is_error, output), error.
    """
    v = F.try_parse_json("value")
    checked = files.withColumn("v", F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("file")))))
    rows = checked.select("file", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("ord", "r"))
    rows = rows.filter(F.expr("schema_of_variant(r) like 'OBJECT%' and schema_of_variant(try_variant_get(r, '$.info', 'variant')) like 'OBJECT%' and schema_of_variant(try_variant_get(r, '$.parts', 'variant')) like 'ARRAY%'"))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""), r"\.transcript$", "")
    sid = _string("r", "$.info.sessionID")
    own = F.min(F.when(sid.isNotNull(), F.struct("ord", sid.alias("id")))).over(Window.partitionBy("file"))
    parts = F.coalesce(F.expr("try_variant_get(r, '$.parts', 'array<struct<type:string,text:string,tool:string,state:struct<status:string,output:string,error:string>>>')"), F.array())
    tools = F.filter(parts, lambda p: (p["type"] == "tool") & p["state"]["status"].isin("completed", "error"))
    results = F.transform(tools, lambda p: F.struct(F.coalesce(p["tool"], F.lit("tool")).alias("name"), (p["state"]["status"] == "error").alias("is_error"), F.when(p["state"]["status"] == "error", p["state"]["error"]).otherwise(p["state"]["output"]).alias("output")))
    stamp = F.timestamp_millis(F.expr("try_variant_get(r, '$.info.time.created', 'bigint')"))
    error = F.when(F.expr("schema_of_variant(try_variant_get(r, '$.info.error', 'variant')) like 'OBJECT%'"), F.to_json(_object("r", "$.info.error")))
    return rows.select(F.coalesce(own["id"], stem).alias("session"), "ord", stamp.alias("ts"), _string("r", "$.info.role").alias("role"), text_of_blocks(parts).alias("content"), results.alias("results"), error.alias("error"))
