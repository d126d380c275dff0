"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions.text import title_from_error


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns; no tool ever fails there."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("signal"))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as the turns of a session; `error` events are failed results."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("idx", F.row_number().over(order).cast("long") - 1)
    key = F.get_json_object("props", "$.k").cast("long")
    return rows.select(F.col("user_id").alias("session_id"), "idx", F.lit("tool").alias("role"), F.col("event_type").alias("content"), (F.col("event_type") == "error").alias("is_error"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("signal"), "event_id", "event_type", "ts", "value", key.alias("k"), (key % 10).alias("test"))


def test_events(turns: DataFrame) -> DataFrame:
    """An error as a failing test, a purchase as a passing one; the test is the last digit of the event's key."""
    rows = turns.filter("event_type in ('error', 'purchase')")
    return rows.select("session_id", "idx", F.col("test").cast("string").alias("test"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("kind"), F.lit(0).alias("pos"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a title from their first line."""
    return table(spark, sf_dir, "documents").withColumn("title", title_from_error(F.col("text")))


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries: the name is the title and its words the tags, the brand the scope, the type the type."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.format_string("part-%06d", "p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("title"), F.array("p_brand").alias("scope"), F.split("p_name", " ").alias("tags"), F.concat(F.lit("## Size\n\n"), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("\n")).alias("body"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("size"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions and extraction events: toxic is rejected, low quality dropped at the gate, the rest approved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("n"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "skip").when((F.col("quality") == 1) & (F.col("n") > 5000), "merge").when(F.col("quality") == 1, "approve")
    staged = docs.select("doc_id", F.lit("staged").alias("action"), F.lit(None).cast("string").alias("reason"), F.col("source").alias("model"), F.lit(0).alias("ts"))
    human = rows.select("doc_id", action.alias("action"), F.when(F.col("toxic") == 1, F.concat(F.lit("toxic "), "lang")).alias("reason"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("ts")).filter("action is not null")
    gate = rows.filter("quality = 0 and toxic = 0").select("doc_id", F.lit("gate_drop").alias("action"), F.lit("low quality").alias("reason"), F.lit(None).cast("string").alias("model"), F.lit(2).alias("ts"))
    return staged.unionByName(human).unionByName(gate).withColumnRenamed("doc_id", "candidate_id")
