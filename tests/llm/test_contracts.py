"""The contract of every opN_ query: names, types and rows over whole tables, against plain versions."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from cases import brute_components, brute_licenses, brute_merkle, brute_negatives, brute_substrings, lower, multiset, rows, vectors

from sessionloom.llm import bpe, common, queries

TYPES = {
    "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_toxicity": {"doc_id": "bigint", "p_low_quality": "double", "p_toxic": "double", "toxic": "boolean"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "n_item": "bigint", "n_shared": "bigint"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}
SECRET = "password: hunter2hunter"
TEXTS = [
    "see token=abc123xyz and API_KEY = 'q-1/2+3' AKIA" + "Z9" * 10, "x " + "0123456789abcdef" * 2 + "g", f"b64 {base64.b64encode(SECRET.encode()).decode()} end",
    "Released under the MIT License. Or: mit-license, the Apache\nLicense; GNU General, Public License", "Licensed under CC BY-NC 4.0.", "passwd=" + "a" * 200 + " passwd = short secret:longer_one", "the thing with which ought to be", "und über nicht schön straße", "password\n=hunter22 password= \"hunter22",
]


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def data():
    docs = [(i, t) for i, t in rows(7) if i is not None]
    docs = list({i: (i, t) for i, t in docs}.values())
    return docs + [(1000 + i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def sf(spark, data, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "de" if t and "ü" in t else "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "u", "<b>1</b>"), (1, None, None), (2, "v", "<b>1</b>"), (3, "w", "ü" * 3000), (4, "w", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(7, "the thing with which ought to be"), (8, "none of this is there at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(vectors(3), "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in data], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_rows(spark, sf, data, name):
    df = queries.QUERIES[name](spark, sf)
    have = dict(df.dtypes)
    assert {k: have.get(k) for k in TYPES[name]} == TYPES[name]
    if name not in ("op2_warc", "op7_decontaminate", "op11_hard_negatives"):
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(i for i, _ in data)


def taken(spark, sf, name):
    return [tuple(r[c] for c in TYPES[name]) for r in queries.QUERIES[name](spark, sf).collect()]


def test_op1(spark, sf, data):
    multiset(taken(spark, sf, "op1_substring_dedup"), brute_substrings(data))


def test_op2(spark, sf):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [(0, 8, digest(b"<b>1</b>"), "response", None), (1, 0, digest(b""), "response", None), (2, 8, digest(b"<b>1</b>"), "revisit", 0), (3, 6000, digest("ü".encode() * 3000), "response", None), (4, 0, digest(b""), "revisit", 1)]
    assert sorted(taken(spark, sf, "op2_warc")) == want


def test_op3(spark, sf, data):
    multiset(taken(spark, sf, "op3_jaccard_join"), brute_components(data))


def plain_base(text):
    """Base spans by a scan of each start, written apart from the operator."""
    name, value, out = re.compile("password|passwd|secret|token|api_?key", re.I | re.A), re.compile("[A-Za-z0-9+/_.=-]+"), []
    at = 0
    while m := name.search(text, at):
        i = m.end() + (text[m.end() : m.end() + 1] in ("'", '"') and m.end() < len(text))
        while text[i : i + 1] == " ":
            i += 1
        v = None
        if text[i : i + 1] in (":", "=") and i < len(text):
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            v = value.match(text, i + (i < len(text) and text[i] in "'\""))
        if v is None:
            at = m.start() + 1
            continue
        if len(v[0]) >= 6:
            out.append((m.start(), 0, "assign", v.end()))
        at = v.end()
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_op5(spark, sf, data):
    texts = dict(data)
    found = 0
    for i, n_assign, n_access, n_hex, digest, spans in taken(spark, sf, "op5_secret_scan"):
        base = plain_base(texts[i] or "")
        assert [n_assign, n_access, n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert digest == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        every = [x for x in spans.split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(every)
        found += len(base)
        if i == 1002:
            assert every == [f"assign:4:{4 + len(base64.b64encode(SECRET.encode()))}"]
    assert found >= 7


def test_op6(spark, sf, data):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = {i: own.encode_ordinary(t or "") for i, t in data}
    multiset(taken(spark, sf, "op6_byte_bpe"), [(i, len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t or "")) for i, t in data])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in TYPES[name] if c in want.columns]
    cols = [i for i, c in enumerate(TYPES[name]) if c in want.columns]
    multiset([tuple(r[i] for i in cols) for r in taken(spark, sf, name)], [tuple(r[i] for i in at) for r in want.fetchall()])


def test_op8(spark, sf, data):
    groups = {}
    for i, t in data:
        groups.setdefault(lower(t or ""), []).append(i)
    multiset(taken(spark, sf, "op8_exact_dedup"), [(i, max(g := groups[lower(t or "")]), len(g), i == max(g), sha(lower(t or ""))) for i, t in data])


def test_op9(spark, sf, data):
    got = taken(spark, sf, "op9_language_id")
    texts = dict(data)
    for i, held, lang, score in got:
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in texts[i] or "")) and lang in ("en", "de", "und")


def test_op10(spark, sf, data):
    from tokenizers import Tokenizer

    own, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(data):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(taken(spark, sf, "op10_token_files")) == want


def test_op11(spark, sf):
    want = brute_negatives([(i, v, (k + 1) % 10 if i % 7 == 0 and k is not None else k) for i, v, k in vectors(3)])
    assert len(want) > 100
    multiset(taken(spark, sf, "op11_hard_negatives"), want)


def test_op12(spark, sf, data):
    multiset(taken(spark, sf, "op12_merkle_manifest"), brute_merkle([(i, "s", "de" if t and "ü" in t else "en", len(t or ""), t) for i, t in data]))


def test_op13(spark, sf, data):
    got = taken(spark, sf, "op13_license_scan")
    multiset([r[:6] for r in got], brute_licenses(data))
    assert {r[0]: r[6] for r in got if r[6]} == {1003: "apache,gpl,mit", 1004: "cc-by-nc"} and {r[7] for r in got} == {0.0, 1.0}


def test_what_was_written_can_be_cleared(spark, sf, tmp_path):
    df = common.written(spark.range(5), "some")
    path = df.inputFiles()[0]
    import pathlib

    assert pathlib.Path(path.removeprefix("file://")).exists()
    common.clear(spark)
    assert not pathlib.Path(path.removeprefix("file://")).exists()
