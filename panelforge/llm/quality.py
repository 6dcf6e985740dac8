"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of byte classes and words in it, and the same of
the lines before and after it; neighbouring labels attract or repel each other by four learnt weights
(Lafferty, McCallum and Pereira, 2001). Forward-backward gives each line's probability of being good;
their mean, weighted by length, is the document's quality, calibrated on the rows learnt from.

Labels are of documents. In a good one all lines are taken as good; in a bad one all lines as bad, but
after a first fit those that it finds far more likely good than not change sides, never the worst.

Scale. The fit uses at most ``fit_rows`` labelled documents of ``fit_lines`` lines (a bounded, documented sample, by
hash of the id), picked from the labels; line features are made on the executors. Scoring is one scan of the
whole texts, linear in their lines, that shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import textvec as tv
from panelforge.llm.common import release, slices, staged, text_array

_UPPER, _DIGIT, _MARK, _BAR = (np.zeros(256, dtype=np.int64) for _ in range(4))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[list(b"!#$%&*+/<=>@[]^_{}~\\")] = 1
_BAR[ord("|")] = 1
OWN = 13
#: Lines of a text that the fit takes together; longer texts are several chains there.
CHAIN = 64


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, OWN) features, each line's length in bytes plus one, and the n + 1 line offsets of the
    texts. A text has one line more than it has line breaks."""
    raw, offs = tv.buffers(text)
    n = len(text)
    breaks = np.flatnonzero(raw == 10)
    doc = np.searchsorted(offs, breaks, side="right") - 1
    per = np.bincount(doc, minlength=n) + 1
    lines = np.append(0, np.cumsum(per))
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    w = tv.Words(raw, offs)
    h = w.hashes()
    count = len(start)

    def over(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[raw]))
        return (total[end] - total[start]).astype(float)

    length = (end - start).astype(float)
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    words = (last - first).astype(float)
    of = np.repeat(np.arange(count), last - first)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    marked = (_MARK[raw[w.end - 1]] > 0).astype(float) if len(h) else np.zeros(0)
    distinct = _distinct(of, h, count)
    upto = np.append(np.uint64(0), np.cumsum(tv.mix(h + np.uint64(1)), dtype=np.uint64))
    sums = upto[last] - upto[first]
    owner = np.repeat(np.arange(n), per)
    key = tv.mix(sums + tv.mix(owner.astype(np.uint64)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    copies = ((times[back] > 1) & (words > 0)).astype(float)
    closes = np.isin(raw[np.maximum(end - 1, 0)] if len(raw) else np.zeros(count, np.uint8), list(b".!?:;\"")) & (length > 0)
    total = np.add.reduceat(words, lines[:-1]) if n else np.zeros(0)
    one, word1 = np.maximum(length, 1), np.maximum(words, 1)
    x = np.stack([
        np.ones(count), np.log1p(words) / 4, over(_UPPER) / one, over(_MARK) / one, 4 * over(_BAR) / one, over(_DIGIT) / one,
        1 - distinct / word1, np.bincount(of, weights=again, minlength=count) / word1, np.bincount(of, weights=marked, minlength=count) / word1,
        length / word1 / 10, copies, closes.astype(float), np.log1p(total)[owner] / 6,
    ], axis=1)
    return x, length + 1, lines


def _distinct(of: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """Different words of each line."""
    _, at = np.unique(tv.mix(h + tv.mix(of.astype(np.uint64))), return_index=True)
    return np.bincount(of[at], minlength=count).astype(float)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[lines[:-1]] = 0
    after[lines[1:] - 1] = 0
    return np.hstack([x, before, after])


def marginals(unary: np.ndarray, trans: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward. unary: log odds of good; trans[a, b]: weight of label b
    (1 good) after label a."""
    odds = np.exp(unary.clip(-30, 30)).tolist()
    (t00, t01), (t10, t11) = np.exp(trans).tolist()
    out = np.empty(len(odds))
    for a, b in zip(lines[:-1].tolist(), lines[1:].tolist(), strict=True):
        p = 0.5
        ahead = []
        for t in range(a, b):
            good = odds[t] * ((p * t11 + (1 - p) * t01) if t > a else 1.0)
            bad = (p * t10 + (1 - p) * t00) if t > a else 1.0
            p = good / (good + bad)
            ahead.append(p)
        good = bad = 0.5
        for t in range(b - 1, a - 1, -1):
            p = ahead[t - a]
            x, y = p * good, (1 - p) * bad
            out[t] = x / (x + y)
            g, d = odds[t] * good, bad
            good, bad = t11 * g + t10 * d, t01 * g + t00 * d
            s = good + bad
            good, bad = good / s, bad / s
    return out


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    scale: tuple[float, float]

    def quality(self, text: pa.Array) -> np.ndarray:
        """The calibrated quality of each text."""
        if not len(text):
            return np.zeros(0)
        x, length, lines = line_features(text)
        return self.calibrate(mean_good(marginals(with_neighbours(x, lines) @ self.weights, self.trans, lines), length, lines))

    def calibrate(self, q: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * _logit(q) + b).clip(-30, 30)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = q.clip(1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def mean_good(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * length, lines[:-1]) / np.add.reduceat(length, lines[:-1])


def _ascend(value_and_gradient, params: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    v, s = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        g = value_and_gradient(params)
        v, s = 0.9 * v + 0.1 * g, 0.99 * s + 0.01 * g * g
        params = params + rate * (v / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return params


def _fit_crf(x: np.ndarray, y: np.ndarray, lines: np.ndarray, weight: np.ndarray, rounds: int, start: np.ndarray) -> np.ndarray:
    """Weights and transitions by accelerated gradient ascent on the weighted conditional log-likelihood;
    chains of one length are worked together."""
    d = x.shape[1]
    cut = np.unique(np.concatenate([lines, *[np.arange(a, b, CHAIN) for a, b in zip(lines[:-1], lines[1:], strict=True)]]))
    size = np.diff(cut)
    groups = [(cut[:-1][size == t][:, None] + np.arange(t)[None, :]) for t in np.unique(size)]
    total = weight.sum()

    def gradient(params: np.ndarray) -> np.ndarray:
        w, trans = params[:d], params[d:].reshape(2, 2)
        u = (x @ w).clip(-30, 30)
        e = np.exp(trans)
        gu, gt = np.zeros(len(u)), np.zeros((2, 2))
        for idx in groups:
            t = idx.shape[1]
            pot = np.stack([np.ones(idx.shape), np.exp(u[idx])], axis=2)
            a = np.empty((*idx.shape, 2))
            a[:, 0] = pot[:, 0]
            a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
            for k in range(1, t):
                a[:, k] = pot[:, k] * (a[:, k - 1] @ e)
                a[:, k] /= a[:, k].sum(axis=1, keepdims=True)
            b = np.ones((*idx.shape, 2))
            own = weight[idx]
            label = y[idx]
            for k in range(t - 2, -1, -1):
                nxt = pot[:, k + 1] * b[:, k + 1]
                b[:, k] = nxt @ e.T
                b[:, k] /= b[:, k].sum(axis=1, keepdims=True)
                both = a[:, k][:, :, None] * e[None] * nxt[:, None, :]
                both /= both.sum(axis=(1, 2), keepdims=True)
                pair = own[:, k]
                gt -= (both * pair[:, None, None]).sum(axis=0)
                np.add.at(gt, (label[:, k], label[:, k + 1]), pair)
            m = a * b
            gu[idx] = own * (label - m[..., 1] / m.sum(axis=2))
        return np.concatenate([x.T @ gu, gt.ravel()]) / total - 1e-4 * params

    return _ascend(gradient, start, rounds, 0.1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 6_000, fit_lines: int = 1_000_000) -> Model:
    """Learn from at most fit_rows labelled documents of at most fit_lines lines together, by hash of the id. Rows
    without an id or label are not used; a repeated id counts as good if all its labels do, and is one document (of
    several texts the one least by hash). Null texts are empty. With one kind of label only, and on empty tables,
    every score is 0.5. Other columns, whatever their names, are not touched. Ids are whole numbers."""
    spark = docs.sparkSession
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col(label_col).cast("int")).alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max("__y").alias("__y"), F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b, "__text"):
                x, length, lines = line_features(b.column(2).slice(i, j - i))
                blobs = [x[p:q].astype(np.float32).tobytes() for p, q in zip(lines[:-1], lines[1:], strict=True)]
                sizes = [length[p:q].tolist() for p, q in zip(lines[:-1], lines[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(blobs, pa.binary()), pa.array(sizes, pa.list_(pa.float64()))], names=["id", "y", "x", "length"])

    coded = staged(rows.select("__id", "__y", "__text").mapInArrow(encode, "id long, y int, x binary, length array<double>"), "lines")
    sizes = coded.select("id", F.size("length").alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # at most fit_rows
    fits = np.cumsum([r["n"] for r in sizes]) <= fit_lines
    own = spark.createDataFrame([(r["id"],) for r, fit in zip(sizes, fits, strict=True) if fit], "id long")
    got = sorted(coded.join(F.broadcast(own), "id").collect(), key=lambda r: r["id"])  # at most fit_lines lines
    release(coded)
    none = Model(np.zeros(3 * OWN), np.zeros((2, 2)), (0.0, 0.0))
    if len({r["y"] > 0 for r in got}) < 2:
        return none
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, OWN).astype(float) for r in got]
    lines = np.append(0, np.cumsum([len(p) for p in parts]))
    x = with_neighbours(np.vstack(parts), lines)
    length = np.concatenate([r["length"] for r in got])
    doc_y = np.array([int(r["y"] > 0) for r in got])
    per = np.diff(lines)
    y = np.repeat(doc_y, per)
    # each document counts the same for its kind, and both kinds weigh the same
    share = length / np.repeat(np.add.reduceat(length, lines[:-1]), per)
    kind = np.where(y == 1, 0.5 / max(doc_y.sum(), 1), 0.5 / max((1 - doc_y).sum(), 1))
    weight = share * kind * len(got)
    params = _fit_crf(x, y, lines, weight, 60, np.zeros(x.shape[1] + 4))
    p = marginals(x @ params[: x.shape[1]], params[x.shape[1] :].reshape(2, 2), lines)
    worst = np.repeat(np.minimum.reduceat(p, lines[:-1]), per)
    y = np.where((y == 0) & (p > 0.9) & (p > worst), 1, y)
    params = _fit_crf(x, y, lines, weight, 120, params)
    model = Model(params[: x.shape[1]], params[x.shape[1] :].reshape(2, 2), (1.0, 0.0))
    q = _logit(mean_good(marginals(x @ model.weights, model.trans, lines), length, lines))

    def gradient(s: np.ndarray) -> np.ndarray:
        r = doc_y - 1 / (1 + np.exp(-(s[0] * q + s[1]).clip(-30, 30)))
        return np.array([(r * q).mean(), r.mean()]) - 1e-4 * s

    a, b = _ascend(gradient, np.array([1.0, 0.0]), 600, 0.05)
    return Model(model.weights, model.trans, (max(float(a), 1e-3), float(b)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double from 0 to 1), one row per row of docs. Null and empty texts are one empty line
    and scored as such; null ids stay null; equal texts have equal scores, repeated rows come as often as they do in
    docs; very long texts are one chain; an empty table gives an empty result. Other columns of docs, whatever
    their names, are not touched."""
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b, "__text"):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(shared.value.quality(text_array(b, "__text").slice(i, j - i)))], names=["id", "score"])

    return src.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
