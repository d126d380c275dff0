"""Hard negatives, Merkle manifests and license scans on awkward tables, against plain versions."""

import random

import pytest
from cases import CLASHES, brute_licenses, brute_merkle, brute_negatives, climb, leaf, license_words, multiset, sha, vectors
from pyspark.sql import functions as F

from sessionloom.llm import hard_negatives, licenses, merkle

NAMES = (*CLASHES, "group", "digest", "g", "m", "path", "up", "top", "own", "norm", "v", "is_anchor", "block", "windows", "row", "p", "template", "spans", "extra_seen", "_at", "_task")


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in NAMES})



def negatives(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **how).collect()]


def test_negatives_in_many_buckets_and_waves(spark):
    rows = vectors(5)
    want = brute_negatives(rows)
    multiset(negatives(spark, rows, bucket_bytes=1, anchor_bytes=1), want)  # 64 rows a bucket, 16 anchors a block
    random.Random(1).shuffle(rows)
    multiset(negatives(spark, rows), want)


def test_negatives_prune_by_norm(spark):
    """Long vectors fill the windows first; buckets of short ones, which cannot reach them, are not sent."""
    r = random.Random(2)
    rows = [(i, [r.uniform(3, 4) if i < 200 else r.uniform(0, 0.01) for _ in range(4)], i % 2) for i in range(2000)]
    rows = [(i if i < 200 or i % 100 else i + 1, v, k) for i, v, k in rows]
    sent = []
    own = hard_negatives.written
    hard_negatives.written = lambda df, name: sent.append(own(df, name)) or sent[-1] if name == "pairs" else own(df, name)
    try:
        got = negatives(spark, rows, bucket_bytes=1, anchor_bytes=1)
    finally:
        hard_negatives.written = own
    multiset(got, brute_negatives(rows))
    assert sum(x.count() for x in sent) < 0.5 * 2 * 32  # 32 buckets, one block of anchors, two searches


def test_negatives_of_extreme_tables(spark):
    assert negatives(spark, []) == [] and negatives(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert negatives(spark, [(100, [1.0], 1)]) == []
    assert negatives(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []  # a negative score has no window
    equal = [(i, [1.0, 1.0], int(i > 0) % 2) for i in range(3000)] + [(100, [1.0, 1.0], 1)]
    multiset(negatives(spark, equal, bucket_bytes=1), brute_negatives(equal))
    big = [(0, [3e38], 1), (1, [3e38], 1), (2, [3e38], 2), (3, [1e19], 2)]
    most = (1 << 63) - 1
    assert negatives(spark, big) == [(0, 1, 1, 2, most, most), (0, 1, 2, 3, most, most)]
    exact = [(0, [2.0**22 + 0.5, 1.0], 1), (1, [2.0**22, 0.25], 1), (2, [2.0**22, 0.5], 2), (3, [2.0**22, 0.0], 2), (4, [2.0**22, 0.25], 2)]  # beyond a double
    multiset(negatives(spark, exact), brute_negatives(exact))
    none = spark.createDataFrame([(None, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in hard_negatives.hard_negatives(none, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 65536)]


def documents(seed, n):
    r = random.Random(seed)
    out = [(i, r.choice(("a", "a", "a", "b", "é", "Z", None)), r.choice(("en", None)), r.choice((None, i)), r.choice((None, "", "x\ny", "né\n" * r.randrange(9)))) for i in range(n)]
    return out + [(5, "a", "en", 1, "same id"), (5, "a", "en", 1, "same id"), (None, "b", "en", 1, "no\nid"), (None, None, None, None, None), (7, "", "en", 1, "-"), (n, "lone", "en", 1, "z" * 100_000)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    cols = SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.merkle_manifest(df, "doc_id", "source", cols, {"seen": merkle.leaf_digest(changed if c == "text" else F.col(c) for c in cols)}, **how)


@pytest.mark.parametrize(("n", "levels"), [(0, 4), (1, 4), (60, 1), (400, 2), (700, 4)])
def test_merkle(spark, n, levels):
    rows = documents(n, n)
    got = manifest(spark, rows, levels=levels).withColumn("f", merkle.folded(F.col("seen"), F.col("path"))).withColumn("p", merkle.proof_digest(F.col("path")))
    multiset([(r.doc_id, r.leaf, r.subroot, r.root, r.p, r.f, r.f == r.root) for r in got.collect()], brute_merkle(rows))


def test_merkle_of_extreme_tables(spark, tmp_path):
    assert manifest(spark, []).collect() == []
    one = [(3, None, None, None, "x\n")]
    (r,) = manifest(spark, one).collect()
    assert r.leaf == r.subroot == r.root == leaf(one[0]) and r.path == []
    many = [(i, f"s{i:05}", "en", 1, "t") for i in range(300)]  # as many groups as rows
    multiset([(r.doc_id, r.root) for r in manifest(spark, many, levels=2).collect()], [(i, climb([leaf(x) for x in many])[0]) for i in range(300)])
    rows = documents(9, 50)
    merkle.write_manifest(manifest(spark, rows), str(tmp_path / "m"), "source")
    groups = spark.read.parquet(str(tmp_path / "m/groups")).collect()
    assert sum(g.n_rows for g in groups) == len(rows) and len(groups) == len({r[1] for r in rows})
    assert merkle.leaf_digest is not None and sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def spans(spark, rows, templates=None, **how):
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    templates = licenses.default_templates(spark) if templates is None else spark.createDataFrame(templates, "template int, label string, text string, exact boolean")
    return sorted(((r.doc_id, r.n_words, [(s.label, s.start, s.end, round(s.cover, 3)) for s in r.spans]) for r in licenses.license_spans(df, templates, **how).collect()), key=str)


def test_license_phrases_against_a_plain_version(spark):
    r = random.Random(4)
    vocabulary = ["mit", "MIT", "license", "License", "apache", "general", "public", "the", "é", "x1", "", "licensé"]
    rows = [(i, r.choice((" ", "-", "\n", "_", "\x00", "/ ")).join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " .,-"), (None, "mit license"), (5, rows[5][1]), (303, "mit license " * 20_000)]
    for how in ({}, {"broadcast_bytes": 0}):
        got = [(i, n, [s for s in found if s[2] - s[1] < 5]) for i, n, found in spans(spark, rows, **how)]
        multiset([(i, n, len(s), min((x[1] for x in s), default=None), max((x[1] for x in s), default=None), ",".join(sorted({x[0] for x in s}))) for i, n, s in got], list(brute_licenses(rows)))


def edited(text, every):
    w = text.split()
    for k in range(every, len(w), every):
        w[k] = "other"
    return " ".join(w)


@pytest.mark.parametrize("which", range(len(licenses.NOTICES)))
def test_whole_and_edited_notices(spark, which):
    label, text = licenses.NOTICES[which]
    n = len(license_words(text))
    longer = text.split()
    longer[len(longer) // 2 : len(longer) // 2] = ["two", "more"]
    rows = [(0, f"some words before {text.upper()} and after"), (1, text.replace(" ", "\n  # ")), (2, " ".join(longer)), (3, edited(text, 20)), (4, " ".join(text.split()[: len(text.split()) // 2])), (5, edited(text, 3))]
    got = {i: [s for s in found if s[0] == label and s[2] - s[1] >= 5] for i, _, found in spans(spark, rows)}
    assert got[0] == [(label, 3, 3 + n, 1.0)] and got[1] == [(label, 0, n, 1.0)]
    assert not got[4] and not got[5]
    if n > 40:
        assert [s[1:3] for s in got[2]] == [(0, n + 2)] and len(got[3]) == 1 and 0.8 <= got[3][0][3] < 1


def test_license_templates_of_any_kind(spark):
    rows = [(0, "a b c d e f g"), (1, "a a a a a a a a"), (2, None)]
    templates = [(0, "none", None, True), (1, "one", "a", True), (2, "seven", "a b c d e f g", False), (3, "same", "A a A", True), (4, "seven", "A, b, c, d, e, f, g", True)]
    want = [(0, 7, [("seven", 0, 7, 1.0), ("seven", 0, 7, 1.0)]), (1, 8, [("same", i, i + 3, 1.0) for i in range(6)]), (2, 0, [])]
    assert spans(spark, rows, templates) == want and spans(spark, rows, templates, broadcast_bytes=0) == want
    assert spans(spark, []) == [] and spans(spark, rows, [], broadcast_bytes=0) == [(0, 7, []), (1, 8, []), (2, 0, [])]
