import hashlib
import random

import public_tokenizers
from cases import brute_components, lower, shingles

import corpus_pipeline
from sessionloom.llm import bpe


def test_pipeline_equals_brute_force(spark, tmp_path):
    import tiktoken

    r = random.Random(1)
    say = lambda n: " ".join(r.choice(("the", "and", "with", "thing", "over", "under", "again")) + "abcdefgh"[r.randrange(8)] for _ in range(n))
    data = [(i, say(60)) for i in range(40)]
    data += [(40, data[0][1].upper()), (41, data[1][1] + " extra"), (42, None), (43, "123 456"), (44, say(80) + " one two three four five six seven eight " + say(80)), (45, ""), (46, data[1][1])]
    items = [(0, "one two three four five six seven eight")]
    d = f"{tmp_path}/sf"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = [(i, t) for i, t in data if t and any(c.isalpha() for c in t)]
    last = {lower(t): i for i, t in left}
    left = [(i, t) for i, t in left if last[lower(t)] == i]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, brute_components(left), strict=True) if i == c]
    left = [(i, t) for i, t in left if not any(len(shingles(t) & shingles(x)) * 100 >= 80 * len(shingles(x)) for _, x in items)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {i: (len(own.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    got = {x.doc_id: (x.n_tokens, x.decoded_sha256) for x in corpus_pipeline.run(spark, d).collect()}
    assert got == want and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "byte_bpe"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, d, data, items=((0, "one two three four five six seven eight"),)):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, f"{tmp_path}/a", [], [])).count() == 0
    assert corpus_pipeline.run(spark, tables(spark, f"{tmp_path}/b", [(1, None), (2, ""), (3, "12")])).count() == 0


def test_repeated_and_missing_ids(spark, tmp_path):
    """Rows of one id stand or fall together; rows without an id stay where they are no copies by id."""
    data = [(1, "alpha beta gamma delta epsilon zeta"), (1, "quite another text than that one here"), (None, "a third text that has no id at all"), (2, "alpha beta gamma delta epsilon zeta")]
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in corpus_pipeline.run(spark, tables(spark, f"{tmp_path}/c", data)).collect())
    assert got == [(False, 0), (True, 2)]


def test_stages_keep_the_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    d = tables(spark, f"{tmp_path}/d", [(i, f"some words that number {i} holds in its text") for i in range(5)])
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "chunk", "n", "name", "set_key", "h", "w", "key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, d)
        assert docs.columns == columns and docs.count() == 5
