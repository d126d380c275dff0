"""Small tables with the awkward rows, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Column names that the operators use inside.
CLASHES = ("id", "chunk", "bucket", "keys", "n", "w", "h", "node", "shared", "set_key", "name", "bin", "n_blocks", "row_id", "pos", "data", "same", "first", "score", "lang_pred")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rows(seed=0):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(("alpha", "Beta", "gamma", "dé", "eps", "zeta", "eta")) + str(r.randrange(30)) for _ in range(n))
    base = [words(n) for n in (1, 3, 5, 8, 13, 40, 80, 200)]
    out = [(i, r.choice(base)) for i in range(30)]
    for i in range(30, 60):
        t = r.choice(base[3:]).split(" ")
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = "new" + str(r.randrange(5))
        out.append((i, r.choice((" ", "\n", "\t ")).join(t)))
    passage = words(50)
    out += [(60, words(30) + " " + passage + " " + words(10)), (61, passage + " " + words(60)), (62, passage.upper())]
    long = words(30_000)
    out += [(70, None), (71, ""), (72, " \n\t"), (73, "x" * 9000), (74, "x" * 4096), (75, "X" * 9000), (76, long), (77, long), (78, long + " end"), (0, out[0][1]), (None, "no id"), (None, None)]
    return out


def frame(spark, data=None):
    from pyspark.sql import functions as F

    data = rows() if data is None else data
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).withColumn("lang", F.lit("en"))


def multiset(got, want):
    assert Counter(got) == Counter(want)


def brute_substrings(data, k=35):
    split = [(i, WORD.findall(t or "")) for i, t in data]
    seen = Counter(tuple(w[j : j + k]) for _, w in split for j in range(len(w) - k + 1))
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_components(data):
    sets = [shingles(t) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            ids[root(i)].append(d)
    return [(d, len(sets[i]), min(ids[root(i)], default=d)) for i, (d, _) in enumerate(data)]


def vectors(seed=0, n=1200, dims=8):
    """Vectors of several lengths and norms, with copies of one, ties, nulls and components that are no numbers."""
    r = random.Random(seed)
    out = [(i, [r.gauss(0.3, 1) * r.choice((0.1, 1, 4)) for _ in range(dims)], r.randrange(4)) for i in range(n)]
    out = [(i, out[50][1] if r.random() < 0.2 else v, k) for i, v, k in out]
    return out + [(n, None, 1), (n + 1, [], 1), (1400, [1.0], 2), (n + 3, [None, 1.0], 1), (n + 4, [float("nan")], 1), (n + 5, [float("inf")], 1), (n + 6, [1.0] * dims, None), (1500, [0.0] * dims, 3), (100, out[100][1], out[100][2])]


def brute_negatives(rows, positives=5, negatives=5, is_anchor=lambda i: i % 100 == 0):
    rows = [(i, [math.floor(256 * np.float32(x).astype(float)) for x in v], k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, kind) in enumerate(rows):
        if is_anchor(i):
            every = sorted((-sum(map(int.__mul__, v, w)), j, k) for b, (j, w, k) in enumerate(rows) if b != a)
            for s, j, _ in [x for x in every if x[2] == kind][:positives]:
                out += [(i, j, n, b, -s, -t) for n, (t, b, _) in enumerate([x for x in every if x[2] != kind and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives], 1)]
    return out


def sha(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The root, and for each digest its siblings, level by level, as those before and those after."""
    paths, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for p, at in zip(paths, where, strict=True):
            run = digests[at // 3 * 3 : at // 3 * 3 + 3]
            p.append((run[: at % 3], run[at % 3 + 1 :]))
        where = [at // 3 for at in where]
        digests = [sha(*digests[k : k + 3]) for k in range(0, len(digests), 3)]
    return digests[0] if digests else None, paths


def brute_merkle(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sorted_rows = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    roots = [climb([leaf(r) for r in sorted_rows[s]]) for s in order]
    root, tops = climb([x for x, _ in roots])
    for s, (sub, paths), top in zip(order, roots, tops, strict=True):
        for r, path in zip(sorted_rows[s], paths, strict=True):
            change = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf((*r[:4], r[4].replace("\n", "")) if change else r)
            for before, after in path + top:
                at = sha(*before, at, *after)
            yield r[0], leaf(r), sub, root, sha(*(x for before, after in path + top for x in before + after)), at, at == root


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def brute_licenses(data):
    for i, t in data:
        w = license_words(t)
        at = [(k, label) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        yield i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))
