"""Packing of token sequences: Martello-Toth dominance reduction, then best fit.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is all
that packing needs: a table of at most ``capacity`` rows, whatever the corpus. The reduction (Martello
and Toth, "Lower bounds and reduction procedures for the bin packing problem", 1990) fixes the sets that
provably dominate all others: a piece with its exact complement; a piece with which nothing, only one
more, or only two more pieces fit. Best fit decreasing packs the rest, all equal pieces and all equal
bins at a time. The plan says which ranks of each length go where; a piece's rank is counted in
hashed buckets, so a length that a third of the pieces have is not numbered in one task.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import parallelism, slices, staged, text_array, trim

TOKENIZER = "word_bpe_49k.json"
#: Encoded words, and chunks of them, kept per worker; past it either memory starts anew, and those of the one before
#: that are met again move over. Longer ones than ``LONG`` characters are not kept, so that the memory is bounded in bytes.
MEMORY, CHUNKS, LONG = 60_000, 60_000, 128
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


#: Latin-1 characters in the byte-level alphabet: their UTF-8 bytes as printable characters.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LATIN = {c: "".join(_BYTE_CHARS[b] for b in chr(c).encode()) for c in range(256)}
_PROBE = "It's 10 naïve Straße-words!! [x|y], ÉCOLE we'll été 3.5% don't"


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes. The tokenizer drops white space and
    never joins across it, so texts are encoded chunk by chunk, and each distinct chunk once. A
    tokenizer that does otherwise on a probe is called for whole texts."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chunks_before: dict[str, bytes] = {}
        self.parts_before: dict[str, bytes] = {}
        self.by_chunk = self._slow([_PROBE]) == [b"".join(self._chunk(c) for c in _PROBE.split())]

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _chunk(self, c: str) -> bytes:
        # Latin-1 is all composed and its classes are written out above; the rest goes as it is
        if not c.isascii() and max(c) > "\xff" or "<|" in c:
            return self._slow([c])[0]
        low = c.lower()
        out = []
        for p in [low] if low.isalpha() else _PARTS.findall(low):
            ids = self.parts.get(p)
            if ids is None:
                if len(self.parts) >= MEMORY:
                    self.parts_before, self.parts = self.parts, {}
                ids = self.parts_before.get(p)
                if ids is None:
                    found = [t.id for t in self.model.tokenize(p if p.isascii() and p.isprintable() else p.translate(_LATIN))]
                    ids = struct.pack(f"<{len(found)}I", *found)
                if len(p) <= LONG:
                    self.parts[p] = ids
            out.append(ids)
        return b"".join(out) if len(out) != 1 else out[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._slow(texts)
        out = []
        for t in texts:
            if not t.isprintable() and any(c in t for c in "\x1c\x1d\x1e\x1f"):  # space to Python only
                out += self._slow([t])
                continue
            words = t.split()
            try:
                out.append(b"".join(map(self.chunks.__getitem__, words)))
            except KeyError:
                chunks, get, ids = self.chunks, self.chunks.get, []
                for w in words:
                    x = get(w)
                    if x is None:
                        if len(chunks) >= CHUNKS:
                            self.chunks_before, self.chunks = chunks, {}
                            chunks, get = self.chunks, self.chunks.get
                        x = self.chunks_before.get(w)
                        if x is None:
                            x = self._chunk(w)
                        if len(w) <= LONG:
                            chunks[w] = x
                    ids.append(x)
                out.append(b"".join(ids))
        return out


def _pieces(path: str | None, capacity: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(path)
        for batch in batches:
            text, ids = text_array(batch, text_col), batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            for i, j in slices(batch, text_col):
                rows: list[tuple] = []
                for doc, data in zip(ids.slice(i, j - i).to_pylist(), enc.encode(text.slice(i, j - i).to_pylist()), strict=True):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = data[4 * s : 4 * (s + capacity)]
                        rows.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "crc"])
            trim()
        del enc
        trim()

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, crc): the token pieces of each row of docs, a null text being empty
    and every document ending with token 0. tokenizer_path: a file that every executor has."""
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(_pieces(tokenizer_path, capacity, "__id", "__text"), "id long, piece int, start long, length long, crc long")


def _dominate(n: list[int], c: int) -> list[tuple[int, tuple]]:
    """Fix dominating sets and take them out of n, the pieces of each length. (times, ((length, count), ...))."""
    fixed: list[tuple[int, tuple]] = []
    changed = True
    while changed:
        changed = False
        for j in range(c, 0, -1):
            if not n[j]:
                continue
            room, take = c - j, None
            own = n[j] // 2 if room == j else min(n[j], n[room]) if room else n[j]
            if room == 0:
                take = (n[j], ((j, 1),))
            elif own:
                take = (own, ((j, 2),) if room == j else ((j, 1), (room, 1)))
            else:
                n[j] -= 1
                small = []
                for s in range(1, room + 1):
                    small += [s] * min(n[s], 3 - len(small))
                    if len(small) == 3:
                        break
                top = next((s for s in range(room, 0, -1) if n[s]), 0)
                n[j] += 1
                if not top:
                    take = (n[j], ((j, 1),))
                elif len(small) < 2 or small[0] + small[1] > room:
                    take = (min(n[j], n[top]) if top != j else 1, ((j, 1), (top, 1)) if top != j else ((j, 2),))
                elif top < j and (len(small) < 3 or sum(small) > room):
                    second = next((d for d in range(room // 2, 0, -1) if n[d] and any(n[e] > (e == d) for e in range(d, room - d + 1))), 0)
                    if second and top + second <= room and n[top] > (top == second):
                        times = min(n[j], n[top] // 2) if top == second else min(n[j], n[top], n[second])
                        take = (times, ((j, 1), (top, 2)) if top == second else ((j, 1), (top, 1), (second, 1)))
            if take and take[0]:
                fixed.append(take)
                for s, k in take[1]:
                    n[s] -= k * take[0]
                changed = True
    return fixed


def _best_fit(n: list[int], c: int) -> list[tuple[int, tuple]]:
    """Best fit decreasing over counts: bins with equal room are filled together."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple]] = []

    def put(room: int, times: int, what: tuple) -> None:
        if not times:
            return
        if room == 0:
            done.append((times, what))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, what))

    for s in range(c, 0, -1):
        left = n[s]
        while left:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                q = c // s
                put(c - q * s, left // q, ((s, q),))
                if left % q:
                    put(c - (left % q) * s, 1, ((s, left % q),))
                left = 0
                continue
            room = rooms[k]
            times, what = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            q = room // s
            use = min(times, left // q)
            put(room, times - max(use, 1), what)
            if use:
                put(room - q * s, use, (*what, (s, q)))
                left -= use * q
            else:
                put(room - left * s, 1, (*what, (s, left)))
                left = 0
    return done + [x for r in rooms for x in open_[r]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Sequences for so many pieces of each length: (times, ((length, count), ...))."""
    n = [0] * (capacity + 1)
    for s, k in counts.items():
        n[s] = k
    fixed = _dominate(n, capacity)
    return fixed + _best_fit(n, capacity)


def _places(sequences: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, pieces per sequence, first sequence, offset)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for times, what in sequences:
        offset = 0
        for s, k in what:
            out.setdefault(s, []).append((used.get(s, 0), k, base, offset))
            used[s] = used.get(s, 0) + times * k
            offset += s * k
        base += times
    return {s: np.array(x, dtype=np.int64) for s, x in out.items()}


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id long and offset long to a written table of pieces(): sequences are filled without
    gaps, from offset 0. An empty table gives an empty result; equal pieces are told apart by rank only."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(4 * parallelism(spark))).cast("int"))
    by = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                p = places.value[int(s)]
                k = np.searchsorted(p[:, 0], r[at], "right") - 1
                t = r[at] - p[k, 0]
                seq[at], off[at] = p[k, 2] + t // p[k, 1], p[k, 3] + (t % p[k, 1]) * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    cols = ranked.select("id", "piece", "start", "length", "crc", F.col("rank").cast("long").alias("rank"))
    return cols.mapInArrow(run, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are one token; longer documents are cut every ``capacity`` tokens and only they; null ids stay
    null; repeated rows are packed as often as they come; other columns of docs are not touched."""
    parts = staged(pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    out = pack(parts, capacity)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
