"""Title overlaps and related files meet by keys: the same pairs as all pairs give, without hot keys."""

import random
import string

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import similarity
from sessionloom.operators import extract


def words(t):
    return {w.strip(string.punctuation) for w in t.lower().split()} - {""}


def overlap(a, b):
    x, y = words(a), words(b)
    return 1.0 if a.lower() in b.lower() or b.lower() in a.lower() else len(x & y) / m if (m := min(len(x), len(y))) else 0.0


@pytest.mark.parametrize("least", [0.5, 0.6, 1.0])
def test_title_pairs_are_those_of_all_pairs(spark, least):
    r = random.Random(least)
    make = lambda n: [" ".join(r.choice("a ab abc the The error in file x.py main, foo-bar é ÉX q zz".split()) for _ in range(r.randrange(1, 6))) for _ in range(n)]
    a, b = make(60) + ["a", "ab", " ", "é", "!"], make(60) + ["a", "b", "xyz abc", "", "!?"]
    df = lambda t: spark.createDataFrame([(x,) for x in t], "title string")
    got = {(x.a, x.b, round(x.score, 9)) for x in similarity.title_pairs(df(a), df(b), least).collect()}
    assert got == {(x, y, round(overlap(x, y), 9)) for x in a for y in b if x.strip() and y.strip() and overlap(x, y) >= least}


def test_pairs_stay_within_their_group(spark):
    df = spark.createDataFrame([(g, t) for g in (1, 2) for t in ("one two", f"two one {g}", "three four")], "g int, title string")
    got = {(x.g, x.a, x.b) for x in similarity.title_pairs(df, df, 0.6, ["g"]).collect()}
    assert got == {(g, a, b) for g in (1, 2) for a in ("one two", f"two one {g}") for b in ("one two", f"two one {g}")} | {(g, "three four", "three four") for g in (1, 2)}


def test_common_words_and_beginnings_are_no_keys(spark):
    n = 4000
    rows = spark.range(n).select(F.concat(F.lit("the error in module m"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" was not found")).alias("t"))
    needles, hay = similarity.title_keys(rows, 0.9)
    met = needles.join(hay.groupBy("key").count(), "key")
    # seven words, of which one may be missing: the two rarest are the module's and one that all have; no piece is needed but the rarest
    sizes = [r[1] for r in met.filter("key not like 'w:%'").groupBy("key").agg(F.sum("count")).collect()]
    assert max(sizes) <= 2 * 1000 and needles.filter("key like '3:the%'").isEmpty()
    exact = similarity.title_keys(rows, 1.0)[0].filter("key like 'w:%'")
    assert exact.count() == n and exact.select("key").distinct().count() == n  # only the rarest word of each
    assert similarity.title_pairs(rows.withColumnRenamed("t", "title").limit(300), rows.withColumnRenamed("t", "title").limit(300), 1.0).count() == 300


def test_related_files_are_those_of_all_pairs(spark):
    files = ["click.py", "src/app/main.py", "/a/b", "makefile", ".py", "x/", "/", "Foo.PY", "ab", "a", "src\\x\\y.c", "été/a.py", "a - b", "q.r", "İ/x.py", ""]
    errors = ["in click.py line", "bad SRC/app/main.py:3", "xclick.pyc", "makefiles broke", "/", "nothing", "a - b c", "foo.py", "src\\x\\y.c", "ÉTÉ/A.PY!", "", "q.rs", "zq.r", "src/app/main_py", "see İ/x.py"]
    e = [(s, x) for s in (1, 2) for x in errors]
    d = [(s, x, i) for s in (1, 2) for i, x in enumerate(files) if s == 1 or i % 2]
    got = extract.related_files(spark.createDataFrame(e, "session_id int, error string"), spark.createDataFrame(d, "session_id int, file string, ord int"))
    want = {(s, x): own for s, x in e if (own := [f for t, f, _ in d if t == s and f.lower() in x.lower()])}
    assert {(r.session_id, r.error): r.files for r in got.collect()} == want


def test_related_files_grow_with_their_hits(spark):
    """One session with as many errors as files, each error naming one file: keys meet a few times each, not all times all."""
    n = 3000
    errors = spark.range(n).select(F.lit(1).alias("session_id"), F.concat(F.lit("failed in src/pkg"), F.col("id"), F.lit("/mod.py line "), F.col("id")).alias("error"))
    diffs = spark.range(n).select(F.lit(1).alias("session_id"), F.concat(F.lit("src/pkg"), F.col("id"), F.lit("/mod.py")).alias("file"), F.col("id").alias("ord"))
    anchors = diffs.select(extract._anchor(F.lower("file")).alias("key")).groupBy("key").count()
    assert anchors.agg(F.max("count")).first()[0] == 1 and anchors.filter("key = 't:pkg7'").count() == 1
    got = extract.related_files(errors, diffs)
    assert got.count() == n and got.filter("size(files) = 1").count() == n
