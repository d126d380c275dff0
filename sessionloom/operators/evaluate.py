"""Evaluation of candidates against gold entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions.schema import ENTRY, problem_list
from sessionloom.functions.similarity import title_pairs
from sessionloom.functions.text import claim_headings, strip
from sessionloom.operators.extract import CRITERIA
from sessionloom.operators.stats import rate
from sessionloom.sources.shared import written

#: Overlap from which a candidate matches a gold title or repeats a known one (fixed value).
OVERLAP = 0.6


#: Pairs of a fixture that are matched by one fold; a fixture with more goes through rounds.
FOLD_PAIRS = 1024


def gold_matches(candidates: DataFrame, gold: DataFrame, least: float = OVERLAP, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """(fixture, cand, gold, score): the greedy one-to-one assignment of each fixture, by score, then both positions.

    Pairs are (fixture, pos, title) on both sides. A fixture of a suite is one session with few pairs: those with up to
    fold_pairs are sorted and folded; larger ones are matched by rounds over all their pairs, with the same result.
    """
    left = candidates.filter(strip(F.col("title")) != "").select("fixture", F.col("pos").cast("long").alias("cand"), F.col("title").alias("a"))
    right = gold.filter(strip(F.col("title")) != "").select("fixture", F.col("pos").cast("long").alias("gold"), F.col("title").alias("b"))
    titles = title_pairs(candidates, gold, least, ["fixture"])
    pairs = left.join(titles, ["fixture", "a"]).join(right, ["fixture", "b"]).select("fixture", "cand", "gold", F.col("score").cast("double").alias("score"))
    pairs = written(pairs, "gold-pairs")
    large = pairs.groupBy("fixture").count().filter(F.col("count") > fold_pairs).select("fixture")
    if large.isEmpty():
        return _folded(pairs)
    large = written(large, "large-fixtures")
    return _folded(pairs.join(large, "fixture", "left_anti")).unionByName(best_pairs(pairs.join(large, "fixture", "left_semi")))


def _folded(pairs: DataFrame) -> DataFrame:
    """The greedy assignment by a fold over a fixture's sorted pairs, which carries what is taken."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "cand", "gold")))
    kind = "array<struct<cand:bigint,gold:bigint,score:double>>"

    def take(acc, p):
        free = ~F.exists(acc, lambda t: (t["cand"] == p["cand"]) | (t["gold"] == p["gold"]))
        return F.when(free, F.concat(acc, F.array(F.struct(p["cand"].alias("cand"), p["gold"].alias("gold"), (-p["down"]).alias("score"))))).otherwise(acc)

    folded = pairs.groupBy("fixture").agg(ordered.alias("p")).select("fixture", F.explode(F.aggregate("p", F.array().cast(kind), take)).alias("m"))
    return folded.select("fixture", "m.cand", "m.gold", "m.score")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The greedy assignment of (fixture, cand, gold, score) by rounds: each takes every pair that is the first of all that
    are left of its candidate and of its gold entry, and drops what shares a side with a taken one.

    No fixture is an array or a task: windows are over one candidate or one gold entry. There are as many rounds as the
    longest chain of pairs of which each waits for the one before; every round is written, so lineage stays short.
    """
    order, done = F.struct((-F.col("score")).alias("down"), F.col("cand").alias("c"), F.col("gold").alias("g")), None
    by_cand, by_gold = Window.partitionBy("fixture", "cand"), Window.partitionBy("fixture", "gold")
    while not pairs.isEmpty():
        rows = pairs.withColumn("order", order).withColumn("first_gold", F.min("order").over(by_gold)).withColumn("first_cand", F.min("order").over(by_cand))
        rows = rows.withColumn("taken", (F.col("order") == F.col("first_gold")) & (F.col("order") == F.col("first_cand")))
        rows = rows.withColumn("gone", F.max("taken").over(by_cand)).withColumn("gone", F.col("gone") | F.max("taken").over(by_gold))
        rows = written(rows.filter("taken or not gone").select("fixture", "cand", "gold", "score", "taken"), "matching")
        new, pairs = rows.filter("taken").drop("taken"), rows.filter("not taken").drop("taken")
        done = new if done is None else done.unionByName(new)
    return pairs.select("fixture", "cand", "gold", "score") if done is None else done


def evidence_backed(session: Column, artifacts: Column, excerpt_hash: Column) -> Column:
    return (F.coalesce(session, F.lit("")) != "") & (F.exists(artifacts, lambda a: strip(a) != "") | (F.coalesce(excerpt_hash, F.lit("")) != ""))


def atomic(body: Column) -> Column:
    return claim_headings(body) == 1


def non_redundant(candidates: DataFrame, known: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Candidates whose title overlaps no known title."""
    hit = title_pairs(candidates, known, least).select(F.col("a").alias("title")).distinct()
    return candidates.join(hit, "title", "left_anti")


def repeats_earlier(candidates: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(fixture, pos) of candidates that overlap an earlier one of their fixture. Blank titles are not compared."""
    first = candidates.groupBy("fixture", F.col("title").alias("b")).agg(F.min("pos").alias("before"))
    earliest = title_pairs(candidates, candidates, least, ["fixture"]).join(first, ["fixture", "b"]).groupBy("fixture", F.col("a").alias("title")).agg(F.min("before").alias("before"))
    return candidates.select("fixture", "pos", "title").join(earliest, ["fixture", "title"]).filter("before < pos").select("fixture", "pos")


def fixture_records(candidates: DataFrame, gold: DataFrame, known: DataFrame | None = None, least: float = OVERLAP) -> DataFrame:
    """A scoring record for each candidate of each fixture: seven criteria, the gold title it matched, and what counts.

    Candidates are (fixture, pos, id, type, title, body, valid, session_id, artifacts, excerpt_sha256, the judge's
    criteria as booleans, judge_error); gold is (fixture, pos, title), known (title). With `raw`, the entry's JSON, instead
    of valid, the entry is validated here. Two criteria are checked by rule, one by title overlap with known and earlier candidates, four by the judge. A candidate whose judge failed
    passes none of its four and not all, and keeps the other checks.
    """
    if "raw" in candidates.columns:
        candidates = candidates.withColumn("valid", F.size(problem_list(F.col("raw"), ENTRY)) == 0)
    matched = gold_matches(candidates, gold, least).join(gold.select("fixture", F.col("pos").alias("gold"), F.col("title").alias("matched_gold_title")), ["fixture", "gold"]).select("fixture", F.col("cand").alias("pos"), "matched_gold_title")
    twice = repeats_earlier(candidates, least)
    if known is not None:
        hits = title_pairs(candidates, known, least).select(F.col("a").alias("title")).distinct()
        twice = twice.unionByName(candidates.join(hits, "title", "left_semi").select("fixture", "pos")).distinct()
    rows = candidates.join(matched, ["fixture", "pos"], "left").join(twice.withColumn("duplicate", F.lit(True)), ["fixture", "pos"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    judged = F.lit(True)
    for c in CRITERIA:
        judged = judged & F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumn("evidence_backed", evidence_backed(F.col("session_id"), F.col("artifacts"), F.col("excerpt_sha256"))).withColumn("atomic", atomic(F.col("body")))
    rows = rows.withColumn("passed", F.col("evidence_backed") & F.col("atomic") & ~F.col("duplicate") & judged & F.col("judge_error").isNull()).withColumn("matched", F.col("matched_gold_title").isNotNull())
    return rows.withColumn("counts", F.col("matched") & F.col("passed"))


def metrics(row) -> dict:
    """Of one row of metric_counts: each metric as rate (None without a denominator), numerator and denominator."""
    pairs = {"schema_validity": (row.valid, row.candidates), "precision": (row.good, row.candidates), "recall": (row.matched, row.gold), "duplicate_rate": (row.duplicates, row.candidates), "all_criteria_pass_rate": (row.passed, row.candidates)}
    return {k: {"rate": n / d if d else None, "numerator": n, "denominator": d} for k, (n, d) in pairs.items()} | {"judge_errors": row.judge_errors}


def metric_counts(records: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: what the metrics count over all fixtures' records."""
    n = gold.agg(F.count(F.lit(1)).alias("gold"))
    return records.agg(F.count(F.lit(1)).alias("candidates"), *(F.count_if(c).alias(a) for c, a in (("valid", "valid"), ("counts", "good"), ("matched", "matched"), ("duplicate", "duplicates"), ("passed", "passed"))), F.count_if(F.col("judge_error").isNotNull()).alias("judge_errors")).join(F.broadcast(n))


def summary(records: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of rates over scored candidates (valid, matched, passed, duplicate, judge_error) and the gold count."""
    marks = ("valid", "matched", "passed", "duplicate", "judge_error")
    both = records.select(*marks, F.lit(False).alias("is_gold")).unionByName(gold.select(*(F.lit(False).alias(m) for m in marks), F.lit(True).alias("is_gold")))
    rows = both.agg(F.count_if(~F.col("is_gold")).alias("candidates"), F.count_if("is_gold").alias("gold"), F.count_if("valid").alias("valid"), F.count_if(F.col("matched") & F.col("passed")).alias("good"), F.count_if("matched").alias("matched"), F.count_if("duplicate").alias("duplicates"), F.count_if("passed").alias("passed"), F.count_if("judge_error").alias("judge_errors"))
    return rows.select("candidates", "gold", "judge_errors", rate(F.col("valid"), F.col("candidates")).alias("schema_validity"), rate(F.col("good"), F.col("candidates")).alias("precision"), rate(F.col("matched"), F.col("gold")).alias("recall"), rate(F.col("duplicates"), F.col("candidates")).alias("duplicate_rate"), rate(F.col("passed"), F.col("candidates")).alias("pass_rate"))


def emitted(candidates: DataFrame, most: int | None = None, least: float = OVERLAP) -> DataFrame:
    """The candidates (suite, fixture, ord, title, any more) that a suite's fixtures emit, one fixture after the other, when
    each leaves out titles that overlap one emitted by an earlier fixture, and stops after `most`.

    A title that is left out leaves out no other, so this is the lexicographically first independent set of the overlap
    graph, with the limit. It comes by rounds over all suites: a row is out once an earlier fixture has emitted an
    overlapping title; it is clear once no undecided row of an earlier fixture has one; a clear row is emitted if fewer
    than `most` rows before it in its fixture are emitted or undecided. Overlaps are between distinct titles, and a title
    is known by the first fixture that emits it, so repeated titles make no pairs of rows. The first undecided row of
    every suite is decided in each round; mostly a few rounds do.
    """
    rows = written(candidates.withColumn("_row", F.monotonically_increasing_id()).withColumn("_state", F.lit(None).cast("boolean")), "suite-rows")
    near = written(title_pairs(rows, rows, least, ["suite"]).select("suite", F.col("a").alias("title"), F.col("b").alias("other")), "suite-titles")
    before = Window.partitionBy("suite", "fixture").orderBy("ord", "_row").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0))
    while not rows.filter("_state is null").isEmpty():
        known = rows.groupBy("suite", F.col("title").alias("other")).agg(F.min(F.when(F.col("_state"), F.col("fixture"))).alias("_said"), F.min(F.when(F.col("_state").isNull(), F.col("fixture"))).alias("_open"))
        known = near.join(known, ["suite", "other"]).groupBy("suite", "title").agg(F.min("_said").alias("_said"), F.min("_open").alias("_open"))
        now = rows.join(known, ["suite", "title"], "left")
        out = F.col("_state").isNull() & F.coalesce(F.col("_said") < F.col("fixture"), F.lit(False))
        now = now.withColumn("_state", F.when(out, False).otherwise(F.col("_state"))).withColumn("_clear", F.col("_state").isNull() & ~F.coalesce(F.col("_open") < F.col("fixture"), F.lit(False)))
        if most is not None:
            now = now.withColumn("_taken", count(F.col("_state"))).withColumn("_maybe", count(F.coalesce("_state", F.lit(True))))
            full = F.col("_state").isNull() & (F.col("_taken") >= most)
            now = now.withColumn("_state", F.when(full, False).when(F.col("_clear") & (F.col("_maybe") < most), True).otherwise(F.col("_state")))
        else:
            now = now.withColumn("_state", F.when(F.col("_clear"), True).otherwise(F.col("_state")))
        rows = written(now.select(*rows.columns), "suite-rows")
    return rows.filter("_state").drop("_row", "_state")


def sequential_titles(candidates: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(suite, pos, title): what fixtures of one title each emit one after the other when each knows what was emitted before."""
    return emitted(candidates.select("suite", F.col("pos").cast("long").alias("fixture"), F.lit(0).alias("ord"), "title"), None, least).select("suite", F.col("fixture").alias("pos"), "title")


def first_wins(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """The first row of each key; with `most`, so many of each session."""
    out = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("k = 1").drop("k")
    return out if most is None else out.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).filter(F.col("k") <= most).drop("k")
