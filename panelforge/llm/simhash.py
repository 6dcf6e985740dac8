"""SimHash document fingerprints and the search for near ones.

Terms are the words of a text (white space apart, A-Z lower-cased) and its pairs of neighbouring words,
weighted by 1 + ln of their count; each term's 64-bit hash votes with its weight on every bit (Charikar,
2002). Fingerprints within Hamming radius ``RADIUS`` agree on ``BLOCKS - RADIUS`` of ``BLOCKS`` blocks;
one table for each choice of those blocks, keyed by their bits, brings all such pairs together (Manku,
Jain and Das Sarma, "Detecting near-duplicates for web crawling", 2007).

Scale. A text's neighbour by id comes from one shuffle of the text: rows are dealt into ranges of ids (of an id that
many rows have, of its texts' hashes) whose bounds are quantiles, found by binary search, one range per task; and
the first row of each range is also sent to the range before it. The search shuffles a key per table and distinct
fingerprint and only against the stated queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import textvec as tv
from panelforge.llm.common import parallelism, slices, staged

BLOCKS, RADIUS = 6, 3
_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: One mask per table: the bits of the blocks that must agree.
MASKS = [_signed(sum(((1 << (_EDGES[b + 1] - _EDGES[b])) - 1) << _EDGES[b] for b in own)) for own in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints; 0 for a text without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 19):
            size += len(texts[j])
            j += 1
        w = tv.Words(*tv.buffers(pa.array(texts[i:j], pa.large_string())))
        h = w.hashes()
        for k in range(j - i):
            own = h[w.offs[k] : w.offs[k + 1]]
            if len(own):
                terms, count = np.unique(np.concatenate([own, tv.grams(own, 2)]) if len(own) > 1 else own, return_counts=True)
                weight = (1 + np.log(count)).astype(np.float32)
                votes = np.zeros(64)
                for a in range(0, len(terms), 1 << 16):
                    bits = np.unpackbits(terms[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    votes += weight[a : a + (1 << 16)].astype(np.float64) @ (2.0 * bits - 1.0)
                out[i + k] = np.packbits(votes > 0, bitorder="little").view("<u8")[0]
        i = j
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, about a half for unrelated ones, 0 for opposite ones."""
    return 1 - np.bitwise_count(a ^ b) / 64


def edited(text: str, following: str) -> str:
    """The last half of text (rounded down) replaced by as much of the start of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, extra, id, text), sorted: pairs each with its follower in the bucket; a bucket's last
    row is always an extra one, that of the next bucket."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch | None:
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[1]]
        if not pairs:
            return None
        changed = [edited(a[3], b[3]) for a, b in pairs]
        fp = fingerprints([r[3] for r in rows])
        at = {id(r): k for k, r in enumerate(rows)}
        own, nxt = fp[[at[id(a)] for a, _ in pairs]], fp[[at[id(b)] for _, b in pairs]]
        new = fingerprints(changed)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
        cols = [[a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], sha, own.view(np.int64), new.view(np.int64), likeness(own, new), likeness(own, nxt)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    for b in batches:
        for i, j in slices(b, "text"):
            size = sum(len(r[3]) for r in held)
            for row in zip(*(b.column(k).slice(i, j - i).to_pylist() for k in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20:
                    out = done(held)
                    if out is not None:
                        yield out
                    held, size = held[-1:], len(held[-1][3])
    out = done(held)
    if out is not None:
        yield out


def _dealt(bounds: list[int], firsts: dict[tuple[int, int], list[int]] | None):
    """Rows (id, at, h, text) to the same with their bucket among bounds. firsts: the buckets that also get the row
    (at, h) as an extra one, the first time that it comes in a task; without it, the text is left out."""
    edges, times = np.unique(np.array(bounds, dtype=np.int64), return_counts=True)
    # an id that holds several quantiles fills as many buckets, dealt by the hash of its texts
    base = np.append(0, np.cumsum(times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for b in batches:
            at, h = b.column(1).to_numpy(), b.column(2).to_numpy()
            k = np.searchsorted(edges, at, "left")
            bucket = base[k]
            same = (k < len(edges)) & (at == edges[k.clip(max=max(len(edges) - 1, 0))]) if len(edges) else np.zeros(len(at), bool)
            share = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
            bucket[same] += ((share[same] * times[k[same]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            if firsts is None:
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(1), b.column(2)], names=["bucket", "at", "h"])
                continue
            text = b.column(3)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(at), bool)), b.column(0), b.column(1), b.column(2), text], names=["bucket", "extra", "id", "at", "h", "text"])
            some = [(i, to, key) for i, key in enumerate(zip(at.tolist(), h.tolist(), strict=True)) if key in firsts for to in firsts[key]]
            for i, to, key in some:
                if (key, to) in sent:
                    continue
                sent.add((key, to))
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([True]), *[b.column(c).slice(i, 1) for c in (0, 1, 2)], text.slice(i, 1)], names=["bucket", "extra", "id", "at", "h", "text"])

    return run


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_chars, edited_sha256, fp and edited_fp (64 bits in a long),
    near_edited, near_next, where a document's edited text is edited(text, next document's text), next
    by ascending id and after the last the first.

    Null texts are empty; an empty text has fingerprint 0. Null ids come before all others; rows with
    equal ids follow each other by the hash of their texts, so that a hot id is split. Very long texts are taken
    whole. An empty table gives an empty result. Other columns, whatever their names, are not touched. Ids are whole
    numbers."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("at"), F.xxhash64("text").alias("h"), "text")
    n = 4 * parallelism(spark)
    bounds = src.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    keys = src.select("id", "at", "h").mapInArrow(_dealt(bounds, None), "bucket long, at long, h long")
    firsts = sorted((r["bucket"], r["f"]["at"], r["f"]["h"]) for r in keys.groupBy("bucket").agg(F.min(F.struct("at", "h")).alias("f")).collect())  # one per bucket, n at most
    after: dict[tuple[int, int], list[int]] = {}
    for k, (_, at, h) in enumerate(firsts):
        after.setdefault((at, h), []).append(firsts[k - 1][0])
    dealt = src.mapInArrow(_dealt(bounds, after), "bucket long, extra boolean, id long, at long, h long, text string")
    dealt = dealt.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", "at", "h")
    return dealt.select("bucket", "extra", "id", "text").mapInArrow(_score, _OUT).withColumnRenamed("id", id_col)


def near_classes(prints: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints: (id_col, fp). (fp long, class long, n_within long, near array<long>), one row per distinct fp: class is
    the smallest id that has it. For those of queries (fp) also how many rows of prints have a fingerprint within
    RADIUS of it, and their classes, ascending, its own included: at most as many as the radius has fingerprints; null
    for the others. Null fingerprints are left out; a fingerprint that only rows without an id have is of class null."""
    masks = F.array(*[F.lit(m).cast("long") for m in MASKS])

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("fp", F.posexplode(masks).alias("table", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")

    classes = staged(prints.where("fp is not null").groupBy("fp").agg(F.min(id_col).alias("class"), F.count("*").alias("n")), "fingerprint-classes")
    asked = keyed(queries.where("fp is not null").select("fp").distinct()).withColumnRenamed("fp", "asked")
    diff = F.col("fp").bitwiseXOR(F.col("asked"))
    earliest = F.array_position(F.transform(masks, lambda m: diff.bitwiseAND(m) == 0), True) - 1  # a pair counts in one table only
    found = keyed(classes).join(asked, ["table", "key"]).where((F.bit_count(diff) <= RADIUS) & (earliest == F.col("table"))).select("fp", "asked")
    near = found.join(classes, "fp").groupBy("asked").agg(F.sum("n").alias("n_within"), F.array_sort(F.collect_set("class")).alias("near"))
    return classes.join(near, F.col("fp") == F.col("asked"), "left").select("fp", "class", "n_within", "near")
