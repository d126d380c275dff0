"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import release, written

#: Labelled rows that the chain is fitted on, about, at most.
FIT_ROWS = 20_000
#: A word is a feature if so many rows have it and their rate of the category is off by so many standard deviations, and so much.
LEAST_ROWS, LEAST_Z, LEAST_GAP = 10, 5.0, 0.4
FOLDS, RIDGE = 5, 0.1
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of the word beginnings that are features too: one of them stands for its inflected forms.
BEGINNINGS = (5, 7)
#: Features beside words: many symbols, few words, lines that repeat.
SHAPES = ("\x00symbols", "\x00short", "\x00repeats")


def tokens(text: str) -> set[str]:
    """The distinct lower-case words of a whole text, the beginnings of longer ones, and the text's shapes."""
    words = _WORD.findall(text.lower())
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in out if len(w) > n and w[-1] != "*"}
    symbols = sum(text.count(c) for c in "#$%&*@^~|<>{}=")
    if symbols * 40 > max(1, len(text)):
        out.add(SHAPES[0])
    if len(words) < 8:
        out.add(SHAPES[1])
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 3 and len(set(lines)) * 3 < len(lines) * 2:
        out.add(SHAPES[2])
    return out


class _Rows:
    """A matrix of rows with a 1 for each of their words, kept as places, and some dense columns, the last of ones."""

    def __init__(self, at: np.ndarray, word: np.ndarray, n: int, words: int, dense: np.ndarray):
        self.at, self.word, self.n, self.words = at, word, n, words
        self.dense = np.column_stack((dense, np.ones(n)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.word], minlength=self.n) + self.dense @ w[self.words :]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.word, weights=v[self.at], minlength=self.words), self.dense.T @ v))

    def squares(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.word, weights=v[self.at], minlength=self.words), (self.dense**2).T @ v))


def _placed(hits: list, words: np.ndarray, size: int, dense: np.ndarray) -> _Rows:
    """The rows' hits among the chosen words, which are numbered in order."""
    number = np.full(size, -1)
    number[words] = np.arange(len(words))
    at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    word = number[np.concatenate([np.zeros(0, int), *(np.asarray(h, int) for h in hits)])]
    return _Rows(at[word >= 0], word[word >= 0], len(hits), len(words), dense)


def _solve(x: _Rows, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each by conjugate gradients; the last weight is the intercept."""
    size = x.words + x.dense.shape[1]
    w, ridge = np.zeros(size), np.full(size, RIDGE)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = _sigmoid(x.times(w))
        d = p * (1 - p)
        near = x.squares(d) + ridge
        left = x.back(y - p) - ridge * w
        least, step = 1e-9 * np.sqrt(left @ left) + 1e-12, np.zeros(size)
        z = left / near
        way, rz = z, left @ z
        for _ in range(2 * size + 50):
            if np.sqrt(left @ left) <= least:
                break
            bent = x.back(d * x.times(way)) + ridge * way
            far = rz / (way @ bent)
            step, left = step + far * way, left - far * bent
            z = left / near
            way, rz = z + (left @ z) / rz * way, left @ z
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling a row positive has the best F1, midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = np.where(np.append(np.diff(p[order]), -1.0) < 0, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), 0)
    k = int(f1.argmax())
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _weights(x: _Rows, y: np.ndarray) -> np.ndarray:
    """The linear model; a constant if a class has no row."""
    if len(y) and 0 < y.mean() < 1:
        return _solve(x, y)
    w = np.zeros(x.words + x.dense.shape[1])
    w[-1] = 30.0 if len(y) and y[0] else -30.0
    return w


def _chosen(counts: np.ndarray, hits: np.ndarray, rows: float, positives: np.ndarray) -> np.ndarray:
    """Which words tell a category apart: of counts rows with each word, hits[category] are positive."""
    out = np.zeros(len(counts), bool)
    for h, pos in zip(hits, positives, strict=True):
        if not 0 < pos < rows:
            continue
        rate, n = pos / rows, np.maximum(counts, 1)
        z = (h - n * rate) / np.sqrt(n * rate * (1 - rate))
        out |= (counts >= LEAST_ROWS) & (z >= LEAST_Z) & (np.abs(h / n - rate) >= LEAST_GAP)
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict:
    """The chain for the categories in order; each value is SQL for a 0/1 label over `labels`.

    Fitted on at most about fit_rows labelled documents, chosen by a hash of their id. Equal texts count once, with
    the larger label of each category, so neither repeated label rows nor their order matter. Spark counts words by
    category and fold; the driver gets the words that tell a category apart, and the sample's hits of them: both are
    bounded by the sample. A model takes all such words. Each model sees the words and the earlier categories' probabilities. In training these come from models that
    did not see the row (FOLDS folds by text hash): their words, too, are chosen without the fold. In prediction they
    come from the model fitted on all rows. A category without both classes gets a constant. `limits` has the
    probability from which each category is called, by the best F1 of the unseen-row probabilities.
    """
    n = labels.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    marks = labels.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
    names = [f"y{i}" for i in range(len(categories))]
    marks = marks.select(id_col, *(F.expr(sql).cast("double").alias(y) for y, sql in zip(names, categories.values(), strict=True))).dropna()
    marks = marks.groupBy(id_col).agg(*(F.max(y).alias(y) for y in names))
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(marks, id_col)
    rows = rows.groupBy("text").agg(*(F.max(y).alias(y) for y in names)).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int"))
    row = F.sha2("text", 256).alias("row")

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                own = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([pa.array([sorted(tokens(t)) for t in own.column(0).to_pylist()], pa.list_(pa.string())), *own.columns[1:]], names=["words", "row", "fold", *names])
        release()

    doubles = ", ".join(f"{y} double" for y in names)
    sample = written(rows.select("text", row, "fold", *names).mapInArrow(cut, f"words array<string>, row string, fold int, {doubles}"), "sample")
    by_fold = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in names)).collect()}
    size = np.array([by_fold[k]["n"] if k in by_fold else 0 for k in range(FOLDS)], float)
    positives = np.array([[by_fold[k][y] if k in by_fold else 0 for k in range(FOLDS)] for y in names], float)
    own = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{c}_{k}") for c, v in (("n", F.lit(1)), *((y, F.col(y)) for y in names)) for k in range(FOLDS)]
    by = sample.select(F.explode("words").alias("word"), "fold", *names).groupBy("word").agg(*own).filter(" + ".join(f"n_{k}" for k in range(FOLDS)) + f" >= {LEAST_ROWS}")
    # only words whose rate is off by enough in some training rows come to the driver, which then chooses exactly
    rate = lambda y: F.lit(float(min((positives[names.index(y)].sum() - np.append(positives[names.index(y)], 0)) / np.maximum(size.sum() - np.append(size, 0), 1))))
    total = lambda c: F.expr(" + ".join(f"{c}_{k}" for k in range(FOLDS)))
    near = [F.greatest(*(((total(y) - F.col(f"{y}_{k}")) / F.greatest(total("n") - F.col(f"n_{k}"), F.lit(1))) for k in range(FOLDS)), total(y) / total("n")) >= rate(y) + LEAST_GAP - 1e-9 for y in names]
    got = by.filter(functools.reduce(lambda a, b: a | b, near)).orderBy("word").toPandas() if size.sum() else pd.DataFrame({"word": []})
    count = np.array([got.get(f"n_{k}", []) for k in range(FOLDS)], float).reshape(FOLDS, len(got))
    hit = np.array([[got.get(f"{y}_{k}", []) for k in range(FOLDS)] for y in names], float).reshape(len(names), FOLDS, len(got))
    picks = [_chosen(count.sum(0) - count[k], hit.sum(1) - hit[:, k], size.sum() - size[k], positives.sum(1) - positives[:, k]) for k in range(FOLDS)]
    picks.append(_chosen(count.sum(0), hit.sum(1), size.sum(), positives.sum(1)))
    used = np.flatnonzero(np.any(picks, axis=0))
    words = [str(w) for w in got["word"].to_numpy()[used]]
    columns = [np.flatnonzero(p[used]) for p in picks]
    number = {w: i for i, w in enumerate(words)}

    def hits(batches):
        for batch in batches:
            at = [[number[w] for w in x if w in number] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), *batch.columns[1:]], names=["hits", "row", "fold", *names])

    data = sample.mapInArrow(hits, f"hits array<int>, row string, fold int, {doubles}").orderBy("row").toPandas()
    found = data["hits"].tolist()
    fold, weights, limits, earlier = data["fold"].to_numpy(int), [], [], np.zeros((len(data), 0))
    for y in names:
        t, out = data[y].to_numpy(float), np.zeros(len(data))
        for k in range(FOLDS):
            mine = fold == k
            part = lambda rows, k=k: _placed([found[i] for i in np.flatnonzero(rows)], columns[k], len(words), earlier[rows])
            out[mine] = _sigmoid(part(mine).times(_weights(part(~mine), t[~mine])))
        weights.append(_weights(_placed(found, columns[-1], len(words), earlier), t))
        limits.append(_threshold(out, t) if len(t) and 0 < t.mean() < 1 else 0.5)
        earlier = np.column_stack((earlier, out))
    return {"words": [words[i] for i in columns[-1]], "weights": weights, "categories": list(categories), "limits": limits}


def predict_chain(docs: DataFrame, chain: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and a probability for each category, by the whole text. A null text counts as empty."""
    number, weights = {w: i for i, w in enumerate(chain["words"])}, chain["weights"]
    kind, cols = docs.schema[id_col].dataType.simpleString(), [f"p_{c}" for c in chain["categories"]]

    def run(batches):
        for batch in batches:
            at = [[number[w] for w in tokens(t or "") if w in number] for t in batch.column(1).to_pylist()]
            said = np.zeros((batch.num_rows, 0))
            for w in weights:
                said = np.column_stack((said, _sigmoid(_placed(at, np.arange(len(number)), len(number), said).times(w))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(said[:, i]) for i in range(len(weights)))], names=["id", *cols])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"`{c}` double" for c in cols)).withColumnRenamed("id", id_col)


#: The categories that the labels table has, in the chain's order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return predict_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= chain["limits"][1])
