"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import mix, parts, release

#: Labelled rows that the model is fitted on, about, at most.
FIT_ROWS = 20_000
#: Rows that each language has in the sample, about, if it has as many, however many languages there are.
LANG_ROWS = 100
#: Log-probability that a change of language between two words costs.
SWITCH = 8.0
#: Letters times languages whose words are decoded together; characters that are scored together; a longer text than
#: LONG characters goes through in segments, so memory follows neither its length nor the number of languages.
GROUP_CELLS, PIECE, LONG = 16 << 20, 1 << 18, 1 << 21
#: First and last code point of each script's main blocks (fixed values).
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)
#: Rows of the table: hashed trigrams, hashed single letters, then a row for each script and one for the rest.
GRAMS, LETTERS = 1 << 16, 1 << 12
_TABLES: dict[str, np.ndarray] = {}


def _alpha(codes: np.ndarray) -> np.ndarray:
    if "alpha" not in _TABLES:
        _TABLES["alpha"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES["alpha"][codes]


def _script(codes: np.ndarray) -> np.ndarray:
    if "script" not in _TABLES:
        of = np.full(0x110000, len(SCRIPTS), np.uint8)
        for k, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                of[a : b + 1] = k
        _TABLES["script"] = of
    return _TABLES["script"][codes]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _features(texts: list[str]):
    """Trigram, letter and script numbers of every letter; word starts and ends; where each text begins, in code points."""
    joined = "\n".join(_lower(t) for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _alpha(codes)
    a = np.where(alpha, codes, 1).astype(np.uint64)
    edge = np.diff(np.concatenate(([False], alpha)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    left, right = np.concatenate(([np.uint64(1)], a[:-1])), np.concatenate((a[1:], [np.uint64(1)]))
    grams = (mix((left << np.uint64(42)) | (a << np.uint64(21)) | right) & np.uint64(GRAMS - 1)).astype(np.int64)
    letters = (mix(a) & np.uint64(LETTERS - 1)).astype(np.int64) + GRAMS
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return alpha, grams, letters, _script(codes).astype(np.int64) + GRAMS + LETTERS, starts, ends, offsets


def _even(sizes: list[int], total: int) -> float:
    """The most that each may have so that all have total together; those with less have all of theirs."""
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > total:
            return total / (len(sizes) - i)
        total -= n
    return max(sizes)


def fit(train: DataFrame, text_col: str, lang_col: str, key_col: str, fit_rows: int = FIT_ROWS) -> dict | None:
    """Feature counts by language over a sample of at most about fit_rows labelled rows, chosen by a hash of the key.

    Languages share the sample evenly; one with fewer rows than its part is taken whole and leaves the rest to the
    others, so a rare language is learned at any size. The counts are summed in Spark; the driver gets at most table size x languages of them. None without rows.
    """
    labelled = train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    name = F.col(lang_col).cast("string")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy(name.alias("lang")).count().collect()}
    if not sizes:
        return None
    most = max(_even(list(sizes.values()), fit_rows), LANG_ROWS)
    cut = [F.lit(x) for lang, n in sorted(sizes.items()) if n > most for x in (lang, int(most / n * (1 << 30)))]
    below = F.coalesce(F.create_map(*cut)[name], F.lit(1 << 30)) if cut else F.lit(1 << 30)
    rows = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(key_col).cast("string")), F.lit(1 << 30)) < below)
    size = GRAMS + LETTERS + len(SCRIPTS) + 1

    def count(batches):
        for batch in batches:
            pairs = [(x, lang) for t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in pieces(t)]
            texts, langs = [x for x, _ in pairs], [lang for _, lang in pairs]
            by: dict[str, np.ndarray] = {}
            for i, j in parts([len(t) for t in texts], PIECE):
                alpha, grams, letters, script, _, _, offsets = _features(texts[i:j])
                for k, lang in enumerate(langs[i:j]):
                    s = slice(offsets[k], offsets[k + 1])
                    on = alpha[s]
                    every = np.concatenate([x[s][on] for x in (grams, letters, script)])
                    if lang not in by:
                        by[lang] = np.zeros(size, np.int64)
                    np.add.at(by[lang], every, 1) if len(every) < 2000 else by.__setitem__(lang, by[lang] + np.bincount(every, minlength=size))
            for lang, c in by.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "feature", "n"])
        release()

    counts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, "lang string, feature int, n long")
    got = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique()) or sorted(r[0] for r in labelled.select(F.col(lang_col).cast("string")).distinct().collect())
    table = np.zeros((size, len(langs)))
    table[got["feature"].to_numpy(int), np.searchsorted(langs, got["lang"].to_numpy(str))] = got["n"].to_numpy(float)
    logs = np.log(table[: GRAMS + LETTERS] + 0.5)
    for a, b in ((0, GRAMS), (GRAMS, GRAMS + LETTERS)):
        logs[a:b] -= np.log(table[a:b].sum(0) + 0.5 * (b - a))
    scripts = table[GRAMS + LETTERS :]
    fits = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    fits[~fits.any(1)] = True  # a script that no language has narrows nothing
    logs -= logs.mean(1, keepdims=True)
    return {"langs": langs, "logs": logs.astype(np.float32), "fits": fits}


def pieces(text: str, size: int = PIECE):
    """The text in pieces of about `size` characters, cut between a letter and what is none; one word is never cut."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def word_scores(model: dict, texts: list[str]):
    """Scores [word, language] of all texts' words, their starts and ends in their text, and each text's first word."""
    alpha, grams, letters, script, starts, ends, offsets = _features(texts)
    logs = model["logs"]
    each = logs[grams]
    each += 0.5 * logs[letters]
    each[~alpha] = 0
    sums = np.zeros((len(each) + 1, each.shape[1]))
    np.cumsum(each, axis=0, dtype=np.float64, out=sums[1:])
    scores = (sums[ends] - sums[starts]).astype(np.float32)
    scores[~model["fits"][script[starts] - GRAMS - LETTERS]] = -1e3
    first = np.searchsorted(starts, offsets)
    shift = np.repeat(offsets[:-1], np.diff(first))
    return scores, (starts - shift).astype(np.int32), (ends - shift).astype(np.int32), first


def _step(best: np.ndarray, scores: np.ndarray, switch: float):
    """The best sums after one more word, and from which language each came: its own, else the best one."""
    top = best.argmax(1)
    move = best[np.arange(len(best)), top] - switch
    stay = best >= move[:, None]
    came = np.where(stay, np.arange(best.shape[1], dtype=np.int16), top[:, None].astype(np.int16))
    best = np.where(stay, best, move[:, None]) + scores
    best -= best.max(1, keepdims=True)
    return best, came


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, all texts at once: step t decodes the t-th word of every text that has one."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, length = first[:-1][order], n[order]
    came = np.zeros(scores.shape, np.int16)
    path = np.zeros(len(scores), np.int16)
    if not len(scores):
        return path
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts with more than t words
    best = scores[at[: active[0]]].astype(np.float64)
    last = np.zeros(len(at), np.int16)
    for t in range(1, steps):
        m, was = active[t], active[t - 1]
        if m < was:
            last[m:was] = best[m:].argmax(1)
            best = best[:m]
        rows = at[:m] + t
        best, came[rows] = _step(best, scores[rows], switch)
    last[: len(best)] = best.argmax(1)
    state = last.copy()
    for t in range(steps - 1, -1, -1):
        m = active[t]
        rows = at[:m] + t
        path[rows] = state[:m]
        if t:
            state[:m] = came[rows, state[:m]]
    return path


def _long_path(model: dict, text: str, switch: float):
    """(scores, starts, ends, path) of a long text's segments, the last first: the sums at the segments' starts are kept,
    and each segment is scored and decoded again on the way back."""
    cut, at = [], 0
    for piece in pieces(text):
        cut.append((at, at + len(piece)))
        at += len(piece)
    best, before, live = None, [], []
    for a, b in cut:
        scores = word_scores(model, [text[a:b]])[0]
        if not len(scores):
            continue
        live.append((a, b))
        before.append(best)
        for t in range(len(scores)):
            best = scores[:1].astype(np.float64) if best is None else _step(best, scores[t : t + 1], switch)[0]
    state = None if best is None else int(best.argmax(1)[0])
    for (a, b), best in zip(reversed(live), reversed(before), strict=True):
        scores, starts, ends, _ = word_scores(model, [text[a:b]])
        came, path = np.full(scores.shape, -1, np.int16), np.zeros(len(scores), np.int16)
        for t in range(len(scores)):
            if best is None:
                best = scores[:1].astype(np.float64)
            else:
                best, came[t : t + 1] = _step(best, scores[t : t + 1], switch)
        for t in range(len(scores) - 1, -1, -1):
            path[t] = state
            if came[t, state] >= 0:
                state = int(came[t, state])
        yield scores, starts.astype(np.int64) + a, ends.astype(np.int64) + a, path


def _answer(langs: list[str], letters: np.ndarray, sums: np.ndarray, runs: list[tuple[int, int, int]]):
    """Language, score and spans from each language's letters, its words' score sums, and the runs (language, start, end)."""
    top = int(letters.argmax())
    rest = np.delete(sums[top], top)
    margin = sums[top][top] - rest.max() if len(rest) else 50.0
    score = letters[top] / letters.sum() / (1 + np.exp(-np.clip(margin, -50, 50)))
    return langs[top], float(score), ",".join(f"{langs[x]}:{a}:{b}" for x, a, b in runs)


def _runs(path: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
    return [(int(path[a]), int(starts[a]), int(ends[b - 1])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _label_long(model: dict, text: str, switch: float):
    k = len(model["langs"])
    letters, sums, runs = np.zeros(k), np.zeros((k, k)), []
    for scores, starts, ends, path in _long_path(model, text, switch):
        letters += np.bincount(path, weights=ends - starts, minlength=k)
        for x in np.unique(path):
            sums[x] += scores[path == x].sum(0, dtype=np.float64)
        own = _runs(path, starts, ends)
        if runs and own[-1][0] == runs[0][0]:
            own[-1] = (own[-1][0], own[-1][1], runs.pop(0)[2])
        runs = own + runs
    return _answer(model["langs"], letters, sums, runs) if runs else ("und", 0.0, "")


def _label(model: dict | None, texts: list[str | None], switch: float):
    """(language, score, spans) of each text."""
    out = [("und", 0.0, "")] * len(texts)
    live = [i for i, t in enumerate(texts) if t] if model and model["langs"] else []
    for i in live:
        if len(texts[i]) > LONG:
            out[i] = _label_long(model, texts[i], switch)
    live = [i for i in live if len(texts[i]) <= LONG]
    if not live:
        return out
    own, k = [texts[i] for i in live], len(model["langs"])
    blocks, base = [], 0
    for i, j in parts([len(t) for t in own], PIECE):
        s, a, b, f = word_scores(model, own[i:j])
        blocks.append((s, a, b, f[:-1] + base))
        base += len(s)
    scores, starts, ends = (np.concatenate([x[c] for x in blocks]) for c in range(3))
    first = np.concatenate([*(x[3] for x in blocks), [base]])
    path = viterbi(scores, first, switch)
    for n, i in enumerate(live):
        p, q = int(first[n]), int(first[n + 1])
        if p == q:
            continue
        letters = np.bincount(path[p:q], weights=ends[p:q] - starts[p:q], minlength=k)
        sums = np.zeros((k, k))
        top = int(letters.argmax())
        sums[top] = scores[p:q][path[p:q] == top].sum(0, dtype=np.float64)
        out[i] = _answer(model["langs"], letters, sums, _runs(path[p:q], starts[p:q], ends[p:q]))
    return out


def identify(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), switch: float = SWITCH) -> DataFrame:
    """One row per row of df: id, the columns named in keep, lang_pred, score and spans (lang:start:end, comma-joined).

    The predicted language is the one whose spans hold most letters; score is its share of the letters times its
    certainty against the next language over those spans. Of languages that tie, the first by name. A null text, one
    without a letter, or a missing model gives `und`, 0 and no spans. Whole texts of any length; repeated rows give
    repeated results. No shuffle; the model, of fixed size for each language, is sent to the tasks.
    """

    group = GROUP_CELLS // max(4, len(model["langs"]) if model else 1)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 4).to_pylist()
            for i, j in parts(sizes, group):
                cols = list(zip(*_label(model, batch.column(0).slice(i, j - i).to_pylist(), switch), strict=True))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True))], names=schema_names)
            release()

    rows = df.select(F.col(text_col).alias("_text"), id_col, *keep)
    schema_names = [id_col, *keep, "lang_pred", "score", "spans"]
    types = [df.schema[c].dataType.simpleString() for c in (id_col, *keep)] + ["string", "double", "string"]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(schema_names, types, strict=True)))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning; a null id has no remainder and counts as not held out, nor is it learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> dict | None:
    return fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "text", "lang", "doc_id")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs, learned(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
