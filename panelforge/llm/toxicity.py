"""Severity of toxic text by cumulative-link ordinal regression.

The grades are ordered: 0 for rows labelled clean; rows labelled toxic get 1, 2 or 3 by how strongly a model that has
not seen them takes them for toxic: the labelled rows are halved, each half is graded by thirds of the log odds that
the two-grade model of the other half gives its toxic rows. One weight vector then serves all thresholds
(McCullagh, "Regression models for ordinal data", 1980): P(grade <= j) = sigmoid(theta_j - w.x). Sparse features
are words and their first and last letters, which meet the inflected forms that a list of words would miss. A
feature is kept if its share of toxic rows is beyond chance for as many features as were tried: by Chernoff's bound
on each, at most one of those kept, or a share of ``FALSE``, is false (Benjamini and Hochberg, 1995).

Scale. Only the fit looks at labels, on at most ``fit_rows`` labelled documents (a bounded, documented sample,
by hash of the id), picked from the labels alone and broadcast to one scan of the text. Scoring is one
scan that shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import release, staged, texts

HEAD, TAIL = (3, 4, 5, 6), (4, 5)
GRADES = 4
#: The expected share of false features among those kept, or one feature.
FALSE = 0.1
_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words, and as "x-" and "-x" their first and last letters."""
    words = set(_WORDS.findall(text.lower()))
    out = {"=" + w for w in words}
    for k in HEAD:
        out |= {w[:k] + "-" for w in words if len(w) > k}
    for k in TAIL:
        out |= {"-" + w[-k:] for w in words if len(w) > k}
    return out


@dataclass
class Model:
    """index: the number of each feature; weights: theirs; cuts: theta, ascending."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def tables(self) -> tuple[dict, list, list]:
        whole = {f[1:]: i for f, i in self.index.items() if f[0] == "="}
        heads = [(k, {f[:-1]: i for f, i in self.index.items() if f[0] != "=" and f[-1] == "-" and len(f) == k + 1}) for k in HEAD]
        tails = [(k, {f[1:]: i for f, i in self.index.items() if f[0] == "-" and len(f) == k + 1}) for k in TAIL]
        return whole, [x for x in heads if x[1]], [x for x in tails if x[1]]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        at_most = 1 / (1 + np.exp(-(self.cuts[None, :] - score[:, None]).clip(-40, 40)))
        return np.diff(np.hstack([np.zeros((len(score), 1)), at_most, np.ones((len(score), 1))]), axis=1)


@dataclass
class Sparse:
    """A matrix of ones: the row and the column of each."""

    row: np.ndarray
    col: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(found: list[list[int]], columns: int) -> Sparse:
        size = [len(x) for x in found]
        col = np.fromiter((c for x in found for c in x), np.int64, sum(size))
        return Sparse(np.repeat(np.arange(len(found)), size), col, (len(found), columns))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.shape[0])

    def transposed(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=d[self.row], minlength=self.shape[1])

    def take(self, rows: np.ndarray) -> Sparse:
        """The given rows, ascending."""
        at = np.full(self.shape[0], -1)
        at[rows] = np.arange(len(rows))
        keep = at[self.row] >= 0
        return Sparse(at[self.row[keep]], self.col[keep], (len(rows), self.shape[1]))


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int = GRADES, ridge: float = 1e-4, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by accelerated gradient ascent on
    the penalised mean log-likelihood. Thresholds are kept apart as theta_1 and log gaps. Grades that no
    row has only widen a gap."""
    n, d = x.shape
    params = np.concatenate([np.zeros(d), [1.0], np.zeros(grades - 2)])
    velocity, square = np.zeros_like(params), np.zeros_like(params)
    low, high = grade - 1, grade
    for step in range(1, rounds + 1):
        w, t = params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])
        s = x @ w
        padded = np.concatenate([t, [np.inf], [-np.inf]])  # index -1: minus infinity
        up, dn = padded[high] - s, padded[low] - s
        fu, fd = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (up, dn))
        fu, fd = np.where(np.isposinf(up), 1.0, fu), np.where(np.isneginf(dn), 0.0, fd)
        p = np.maximum(fu - fd, 1e-12)
        gu, gd = fu * (1 - fu) / p, fd * (1 - fd) / p
        ds = -(gu - gd) / n
        gt = np.zeros(grades - 1)
        np.add.at(gt, high[high < grades - 1], gu[high < grades - 1] / n)
        np.add.at(gt, low[low >= 0], -gd[low >= 0] / n)
        grad = np.concatenate([x.transposed(ds) - ridge * w, [gt.sum()], np.exp(params[d + 1 :]) * np.cumsum(gt[::-1])[::-1][1:]])
        velocity = 0.9 * velocity + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        params = params + 0.1 * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        params[d + 1 :] = params[d + 1 :].clip(-3, 3)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def held_out_grades(x: Sparse, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic rows by thirds of their log odds under the model of the other half of the rows."""
    n = len(toxic)
    half = np.zeros(n, dtype=np.int64)
    for y in (0, 1):  # rows come in an order that has nothing to do with their texts
        half[np.flatnonzero(toxic == y)[1::2]] = 1
    odds = np.zeros(n)
    for k in (0, 1):
        seen = np.flatnonzero(half != k)
        w, cuts = fit_ordinal(x.take(seen), toxic[seen], 2)
        odds[half == k] = (x @ w - cuts[0])[half == k]
    grade = np.zeros(n, dtype=np.int64)
    for k in (0, 1):
        own = np.flatnonzero((half == k) & (toxic == 1))
        if len(own):
            grade[own] = 1 + np.searchsorted(np.quantile(odds[own], [1 / 3, 2 / 3]), odds[own], "left")
    return grade


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 12_000) -> Model:
    """Learn from at most fit_rows labelled documents. Rows without an id or label are not used; a repeated id
    counts as toxic if any of its labels does, and is one document (of several texts the one least by hash). Without
    toxic or without clean rows, and on empty tables, nothing is learnt and all scores are 0. Null texts are empty.
    Of equal features none is preferred: all that are beyond chance are kept. Other columns, whatever their names,
    are not touched. Ids are whole numbers."""
    spark = docs.sparkSession
    nothing = Model({}, np.zeros(0), np.array([2.0, 4.0, 6.0]))
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max("__y").alias("__y"), F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    rows = staged(rows.select("__id", "__y", "__text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        total = [0, 0]

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array(names + [""], pa.string()), pa.array([seen[0][f] for f in names] + [total[0]], pa.int64()), pa.array([seen[1][f] for f in names] + [total[1]], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["f", "clean", "toxic"])

        for b in batches:
            for y, text in zip(b.column(1).to_pylist(), texts(b, "__text"), strict=True):
                y = int(y > 0)
                total[y] += 1
                seen[y].update(features(text))
                if len(seen[0]) + len(seen[1]) > 150_000:
                    yield out()
                    seen, total = (Counter(), Counter()), [0, 0]
        yield out()

    counts = rows.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = staged(counts.where("toxic > 0 or f = ''"), "features")
    total = counts.where("f = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        release(rows, counts)
        return nothing
    rate = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    chance = F.col("toxic") * F.ln(share / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.ln((1 - share) / (1 - rate))).otherwise(0.0)
    tried = max(1, counts.count() - 1)
    able = counts.where((F.col("f") != "") & (share > rate)).select("f", chance.alias("chance"))
    least, many = float(np.log(tried)), -1
    while many < (many := able.where(F.col("chance") > least).count()):  # more features allow more false ones, which lowers the bound
        least = float(np.log(tried / max(1.0, FALSE * many)))
    kept = able.where(F.col("chance") > least).orderBy("f").select("f").collect()  # each in a least number of fit_rows rows
    if not kept:
        release(rows, counts)
        return nothing
    index = {r["f"]: i for i, r in enumerate(kept)}
    at = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(i for f in features(t) if (i := at.value.get(f)) is not None) for t in texts(b, "__text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "found"])

    sample = rows.mapInArrow(encode, "id long, y int, found array<int>").orderBy(F.xxhash64("id"), "id").collect()  # at most fit_rows, of few features
    release(rows, counts)
    x = Sparse.of([r["found"] for r in sample], len(index))
    weights, cuts = fit_ordinal(x, held_out_grades(x, np.array([int(r["y"] > 0) for r in sample])))
    return Model(index, weights, cuts)


def score_rows(model, id_col: str, text_col: str):
    """mapInArrow function: id, expected severity, the most likely grade and P(grade >= 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        whole, heads, tails = m.tables()
        for b in batches:
            total = []
            for text in texts(b, text_col):
                found: set[int] = set()
                if m.index:
                    words = set(_WORDS.findall(text.lower()))
                    found = {whole[w] for w in words & whole.keys()}
                    for k, t in heads:
                        found |= {t[h] for h in t.keys() & {w[:k] for w in words if len(w) > k}}
                    for k, t in tails:
                        found |= {t[h] for h in t.keys() & {w[-k:] for w in words if len(w) > k}}
                total.append(float(m.weights[sorted(found)].sum()) if found else 0.0)
            p = m.probabilities(np.array(total)) if len(total) else np.zeros((0, GRADES))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(1 - p[:, 0])], names=["id", "severity", "grade", "toxic_probability"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, severity double from 0 to 3, grade int, toxic_probability double), one row per row of docs.
    A null text is empty; an empty or very long text is scored like any other, whole; null ids stay null; equal
    texts have equal scores, repeated rows come as often as they do in docs; an empty table gives an empty result.
    Other columns, whatever their names, are not touched."""
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = src.mapInArrow(score_rows(docs.sparkSession.sparkContext.broadcast(model), "__id", "__text"), "id long, severity double, grade int, toxic_probability double")
    return out.withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose probability of being toxic at all is under threshold, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(b.schema.get_field_index(text_col))], names=["__row", text_col])
            for out in score_rows(shared, "__row", text_col)(iter([own])):
                yield b.filter(pa.array(out.column(3).to_numpy() < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
