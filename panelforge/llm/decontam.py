"""Benchmark decontamination with training suffix arrays.

A shard is about a megabyte of a task's texts. Its suffix array holds the suffixes that begin with a
benchmark word sequence of ``SEED`` words (no other suffix can hold a match), sorted by their first
``window`` words, which is as deep as a window can tell suffixes apart. Every benchmark suffix of a window or
more is then found in it by binary search, which gives all its occurrences; those of one item on one diagonal
join to the longest verbatim match of the item.

Scale. Documents are only scanned: no shuffle, and no row leaves its task but the result. The benchmark is a
fixed, published set of questions; its index is arrays of a known size, and beyond ``max_block_bytes`` it is
taken in blocks, each a scan of its own that carries on what the ones before have found, so that workers hold
one block at a time and every row stays one row. A shared prompt costs one window however many items have
it: words are marked by distinct windows, and items are matched a bounded number of places at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import textvec as tv
from panelforge.llm.common import release, slices, staged, text_array

SEED = 3
#: Places of items in a shard that are worked on at once.
PLACES = 1 << 20
#: Parallel lists of a document: covered words as spans; items with their longest match.
FOUND = (("hit_start", "int"), ("hit_length", "int"), ("items", "long"), ("doc_start", "int"), ("item_start", "int"), ("length", "int"))
_ARROW = {"int": pa.int32(), "long": pa.int64()}
_FIELDS = ", ".join(f"{n} array<{t}>" for n, t in FOUND)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + count[0] - 1, start[1] ... and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class _Index:
    """The words of benchmark items as numbers from 1, and their distinct windows, sorted, with the places that
    have each: 4 * window + 16 bytes a word."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        w = tv.Words(*tv.buffers(pa.array([x.decode() for _, x in items], pa.large_string())), kind=tv.ALNUM)
        h = w.hashes()
        self.vocab = np.unique(h)
        ids = (np.searchsorted(self.vocab, h) + 1).astype(np.uint32)
        self.window, self.item = window, np.array([i for i, _ in items], dtype=np.int64)
        size = np.diff(w.offs)
        n = np.minimum(window, size)
        places = np.where(size > 0, size - n + 1, 0)
        owner = np.repeat(np.arange(len(items)), places)
        place = _ranges(np.zeros(len(items), np.int64), places)
        lead = np.concatenate([ids, np.zeros(window, np.uint32)])[(w.offs[:-1][owner] + place)[:, None] + np.arange(window)]
        lead[np.arange(window) >= n[owner][:, None]] = 0
        key, self.first, back = np.unique(_sortable(lead), return_index=True, return_inverse=True)
        self.words = n[owner][self.first]
        self.key = key
        # a shorter item is found wherever a suffix begins with it, whatever comes next
        last = lead[self.first]
        last[np.arange(window) >= self.words[:, None]] = np.iinfo(np.uint32).max
        self.upto = _sortable(last)
        order = np.argsort(back, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.at = np.append(0, np.cumsum(np.bincount(back, minlength=len(key))))
        heads = lead[self.first]
        self.seeds = {m: np.unique(_packed(heads[(np.minimum(SEED, self.words) == m)][:, :m])) for m in range(1, SEED + 1)}

    def suffixes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of one word sequence (0: not a benchmark word, or a text's end): positions
        in order, and the leading ``window`` words of each as big-endian bytes."""
        n = len(ids)
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        found = np.zeros(n, dtype=bool)
        for m, seeds in self.seeds.items():
            if len(seeds):
                known = np.ones(n, dtype=bool)
                for k in range(m):
                    known &= padded[k : k + n] > 0
                at = np.flatnonzero(known)
                packed = _packed(padded[at[:, None] + np.arange(m)])
                spot = np.searchsorted(seeds, packed).clip(max=len(seeds) - 1)
                found[at[seeds[spot] == packed]] = True
        pos = np.flatnonzero(found)
        lead = _sortable(padded[pos[:, None] + np.arange(self.window)])
        order = np.argsort(lead, kind="stable")
        return pos[order], lead[order]

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the window) of every occurrence of a window, by position."""
        pos, lead = self.suffixes(ids)
        lo, hi = np.searchsorted(lead, self.key, "left"), np.searchsorted(lead, self.upto, "right")
        some = np.flatnonzero(hi > lo)
        count = (hi - lo)[some]
        p, k = pos[_ranges(lo[some], count)], np.repeat(some, count)
        order = np.lexsort((k, p))
        return p[order], k[order]

    def longest(self, d: np.ndarray, p: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """(document, item, start in the document, start in the item, words) of each item's longest match in
        each document, the first of equals, for occurrences of whole documents."""
        parts = max(1, -(-int((self.at[k + 1] - self.at[k]).sum()) // PLACES))
        out: list[list[np.ndarray]] = []
        for part in range(parts):
            out.append(self._longest(d, p, k, part, parts))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def _longest(self, d: np.ndarray, p: np.ndarray, k: np.ndarray, part: int, parts: int) -> list[np.ndarray]:
        rows = []
        step = max(1, PLACES // max(1, int((self.at[k + 1] - self.at[k]).max(initial=1))))
        for a in range(0, len(p), step):  # so many occurrences at once that their places fit
            count = (self.at[k + 1] - self.at[k])[a : a + step]
            entry = _ranges(self.at[k[a : a + step]], count)
            which = np.repeat(np.arange(a, min(a + step, len(p))), count)
            own = self.owner[entry] % parts == part
            rows.append((d[which[own]], self.owner[entry[own]], p[which[own]] - self.place[entry[own]], p[which[own]], self.place[entry[own]], self.words[k[which[own]]]))
        doc, owner, diagonal, start, place, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((start, diagonal, owner, doc))
        doc, owner, diagonal, start, place, n = (x[order] for x in (doc, owner, diagonal, start, place, n))
        if not len(doc):
            return [doc, doc, doc, doc, doc]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + n[:-1])]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        length = start[tail] + n[tail] - start[head]
        doc, item, start, place = doc[head], self.item[owner[head]], start[head], place[head]
        order = np.lexsort((place, start, -length, item, doc))
        doc, item, start, place, length = (x[order] for x in (doc, item, start, place, length))
        best = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
        return [x[best] for x in (doc, item, start, place, length)]


def _sortable(lead: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    width = 4 * lead.shape[1]
    return np.ascontiguousarray(lead.astype(">u4")).view(f"S{width}").ravel() if len(lead) else np.zeros(0, f"S{width}")


def _packed(lead: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lead), dtype=np.uint64)
    for k in range(lead.shape[1]):
        out = (out << np.uint64(21)) | lead[:, k].astype(np.uint64)
    return out


def _spans(covered: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the runs of covered words; texts are apart in the sequence."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    d = np.searchsorted(begins, a, "right") - 1
    return d, a - begins[d], b - a


def _lists(d: np.ndarray, n: int, values: np.ndarray, kind: str) -> pa.Array:
    """values, sorted by their document d, as one list per document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64 if kind == "long" else np.int32), _ARROW[kind]))


def _search(bench: _Index, text: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of each text its number of words and the lists of FOUND."""
    n = len(text)
    w = tv.Words(*tv.buffers(text), kind=tv.ALNUM)
    h = w.hashes()
    spot = np.searchsorted(bench.vocab, h).clip(max=max(len(bench.vocab) - 1, 0))
    word = np.where(bench.vocab[spot] == h, spot + 1, 0) if len(bench.vocab) else np.zeros(len(h), np.int64)
    # a gap of zeros after each text keeps matches within it
    size = np.diff(w.offs)
    line = np.zeros(len(h) + n * bench.window, dtype=np.uint32)
    line[np.arange(len(h)) + np.repeat(np.arange(n), size) * bench.window] = word
    begins = w.offs[:-1] + np.arange(n) * bench.window
    p, k = bench.windows(line)
    change = np.bincount(p, minlength=len(line) + 1) - np.bincount(p + bench.words[k], minlength=len(line) + 1) if len(p) else np.zeros(len(line) + 1, np.int64)
    spans = _spans(np.cumsum(change)[: len(line)] > 0, begins, size)
    d = np.searchsorted(begins, p, "right") - 1
    doc, item, start, place, words = bench.longest(d, p - begins[d], k) if len(p) else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((item, doc))
    doc, item, start, place, words = (x[order] for x in (doc, item, start, place, words))
    values = [(spans[0], spans[1]), (spans[0], spans[2]), (doc, item), (doc, start), (doc, place), (doc, words)]
    return size, [_lists(by, n, x, kind) for (by, x), (_, kind) in zip(values, FOUND, strict=True)]


def _united(a: dict, b: dict) -> dict:
    """What two blocks have found in one document: spans united, items (of one block each) together."""
    spans: list[list[int]] = []
    for s, n in sorted([*zip(a["hit_start"], a["hit_length"], strict=True), *zip(b["hit_start"], b["hit_length"], strict=True)]):
        if spans and s <= spans[-1][0] + spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s + n - spans[-1][0])
        else:
            spans.append([s, n])
    both = sorted(zip(*(a[c] + b[c] for c, _ in FOUND[2:]), strict=True))
    return {"hit_start": [s for s, _ in spans], "hit_length": [n for _, n in spans]} | {c: [m[k] for m in both] for k, (c, _) in enumerate(FOUND[2:])}


def _scan(index, text_col: str, first: bool, last: bool):
    """Rows (id, text, and what the blocks before have found) to the same with this block's matches; the last
    block leaves the text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: _Index = index.value
        for batch in batches:
            text = text_array(batch, text_col)
            for i, j in slices(batch, text_col):
                size, lists = _search(bench, text.slice(i, j - i))
                if not first:
                    own = pa.RecordBatch.from_arrays(lists, names=[c for c, _ in FOUND]).to_pylist()
                    rows = [_united(a, b) if b["hit_start"] else a for a, b in zip(batch.slice(i, j - i).select([c for c, _ in FOUND]).to_pylist(), own, strict=True)]
                    lists = [pa.array([r[c] for r in rows], pa.list_(_ARROW[t])) for c, t in FOUND]
                kept = [batch.column(0).slice(i, j - i), *([] if last else [batch.column(1).slice(i, j - i)])]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size.astype(np.int64)), *lists], names=["id", *([] if last else [text_col]), "n_words", *[c for c, _ in FOUND]])

    return run


def _indexes(spark, bench: DataFrame, item_col: str, text_col: str, window: int, max_block_bytes: int) -> Iterator:
    """Broadcast indexes of the benchmark's blocks, of about max_block_bytes each, whether it is the last with it."""
    items = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("item is not null and text is not null").distinct()
    # a word has a letter and a mark between at least; the text itself is collected, too
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] * (1 + (4 * window + 16) // 2)
    blocks = max(1, -(-size // max_block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        yield spark.sparkContext.broadcast(_Index([(r[0], r[1].encode()) for r in rows], window)), k == blocks - 1


def benchmark_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_block_bytes: int = 256 << 20) -> DataFrame:
    """One row per row of docs: id, n_words; the spans of words inside any match as hit_start and hit_length;
    and per matching item its longest verbatim match, the first of equals, as items, doc_start, item_start and
    length (parallel arrays, all in words, items ascending). Words are runs of 0-9, A-Z, a-z and everything
    outside ASCII, lower-cased over A-Z; a match has ``window`` words or is a whole shorter item.

    Null and wordless texts have no words and no matches; a very long text is a shard of its own. Items with a
    null id or without words are left out. Repeated rows, and rows with null ids, are returned as often as
    they come; repeated items count once per id. Other columns of either table are not touched, whatever their
    names. Empty tables give no rows or no matches. Ids are whole numbers."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text"))
    first = True
    for index, last in _indexes(docs.sparkSession, bench, item_col, item_text_col, window, max_block_bytes):
        found = src.mapInArrow(_scan(index, "__text", first, last), f"id long, {'' if last else '__text string, '}n_words long, {_FIELDS}")
        before, src, first = src, found if last else staged(found, "blocks"), False
        if not last:
            release(before)
    return src.withColumnRenamed("id", id_col)


def hit_words() -> F.Column:
    """The number of document words inside any match of benchmark_matches()."""
    return F.aggregate("hit_length", F.lit(0).cast("long"), lambda n, x: n + x)


def _clean(index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: _Index = index.value
        for batch in batches:
            text = text_array(batch, text_col)
            for i, j in slices(batch, text_col):
                spans = _search(bench, text.slice(i, j - i))[1][0]
                yield batch.slice(i, j - i).filter(pa.array(np.diff(spans.offsets.to_numpy()) == 0))

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_block_bytes: int = 256 << 20) -> DataFrame:
    """The rows of docs without a verbatim benchmark match, all columns as they are: the scan of
    benchmark_matches(), which see for words, nulls and ties, as a filter. Rows with null ids are
    judged by their text like all others. Nothing is shuffled."""
    for index, last in _indexes(docs.sparkSession, bench, item_col, item_text_col, window, max_block_bytes):
        before, docs = docs, docs.mapInArrow(_clean(index, text_col), docs.schema)
        if not last:
            docs = staged(docs, "clean")
            release(before)
    return docs
