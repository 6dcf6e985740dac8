"""Personal data: fixed forms, and identifiers found by bootstrapped contextual extraction.

Fixed forms are e-mail addresses, IP addresses, payment cards and phone numbers. They, and long hex
strings (kind "secret"), are the seed entities. A lexical pattern is the one or two words before an
entity, lower-cased, digits as 0. Patterns and instances make a bipartite graph: a pattern scores the share of all
words that follow it which are entities, each with its own score, smoothed by how many different ones there
are; an unknown instance scores by the best pattern it occurs with. Those over ``ACCEPT`` are entities of the next
round and admit patterns that no fixed form follows (Riloff and Jones, "Learning dictionaries for
information extraction by multi-level bootstrapping", 1999), until none is accepted and scores have settled. What follows an
accepted pattern and looks like an identifier is a further span, of the kind most of the pattern's entities
have, by weight.

Scale. One scan finds fixed forms and candidates (strings with a digit, "@" or "_"), a small part of all
words; a second one counts how often patterns occur that could be accepted, filtered by a bitmap of a fixed size,
whose false alarms a join removes. The graph holds distinct edges, aggregated before they are shuffled; rounds
are joins on patterns and instances whose other side has one row per key, so a pattern that a third of all rows
have is split, and nothing is collected but the bitmap. All expressions are linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import textvec as tv
from panelforge.llm.common import join_grouped, release, slices, staged, text_array

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ACCEPT, DOUBT = 0.75, 2
#: A pattern with fewer different instances cannot score ACCEPT.
LEAST = math.ceil(DOUBT * ACCEPT / (1 - ACCEPT))
#: Rounds end when no instance is accepted and their mean score rises by no more.
SETTLED = 1e-3
#: The bitmap of patterns: 8 MB.
BITS = 26

# The fixed forms of the operator's contract; e-mail addresses are found from their "@".
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can only start where a run of digits does
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MANY_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_CHUNK = re.compile(r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+")
#: Groups of digits with single spaces between, and the marks around them.
_GROUPS = re.compile(r"(?<!\S)[^\s0-9A-Za-z@_]{0,3}[0-9][0-9-]*+(?: [0-9][0-9-]*+)+(?![^\s0-9A-Za-z@_]*+[0-9A-Za-z@_])\S*+")
_EDGE = "\"'`()[]{}<>,.;:!?*$%&#|="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of _EMAIL, found from each "@": a match starts where the run of
    local characters before it starts, or where the last match ended."""
    out = []
    upto = 0
    at = t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at + 1)
        if m:
            a = at
            while a > upto and t[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                upto = m.end()
        at = t.find("@", max(at + 1, upto))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed forms, in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(t)] if "@" in t else []
    if "." in t:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    if _MANY_DIGITS.search(t):
        for m in _CARD.finditer(t):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str | None]]:
    """(start, end, seed kind or None): fixed forms and secrets, and other strings that look like
    identifiers and do not overlap with them: of any length, and across single spaces between groups of
    digits."""

    def apart(spans: list[tuple[int, int]]):
        spans = sorted(spans)
        starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        return lambda a, b: not (before := bisect_left(starts, b)) or ends[before - 1] <= a

    out: list[tuple[int, int, str | None]] = [(a, b, KINDS[k]) for a, k, b in base]
    free = apart([(a, b) for a, _, b in base])
    out += [(*m.span(), SECRET) for m in _HEX.finditer(t) if free(*m.span())]
    free = apart([(a, b) for a, b, _ in out])
    groups = [m.span() for m in _GROUPS.finditer(t) if free(*m.span())]
    g = 0
    for m in _CHUNK.finditer(t):
        a, b = m.span()
        while g < len(groups) and groups[g][1] <= a:
            g += 1
        if g < len(groups) and groups[g][0] <= a:
            if groups[g][0] < a:
                continue
            a, b = groups[g]
        if not free(a, b):
            continue
        s = t[a:b]
        a += len(s) - len(s.lstrip(_EDGE))
        b -= len(s) - len(s.rstrip(_EDGE))
        if a < b:
            out.append((a, b, None))
    return out


#: Lower case, digits as 0.
_PLAIN = tv.LOWER.copy()
_PLAIN[48:58] = 48


class _Contexts:
    """The words of texts, and hashes of each word and of each pair of neighbours in a text, as patterns; 0: none."""

    def __init__(self, text: pa.Array):
        raw, offs = tv.buffers(text)
        self.offs = offs
        self.words = tv.Words(_PLAIN[raw], offs, lower=False)
        h = self.words.hashes()
        self.one = tv.mix(h + np.uint64(1)) | np.uint64(1)
        self.two = np.zeros_like(h)
        self.two[1:] = tv.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) | np.uint64(1)
        first = self.words.offs[:-1][np.diff(self.words.offs) > 0]
        self.two[first] = 0

    def before(self, k: int, t: str, starts: list[int]) -> list[tuple[int, int, str]]:
        """Of places in the k-th text, ascending: the patterns of one and of two words before the word that holds
        the place, and the words (for people, at most 80 bytes)."""
        if t.isascii():
            at = np.array(starts, dtype=np.int64)
        else:
            sizes, upto = [], 0
            for s in starts:
                sizes.append(len(t[upto:s].encode()))
                upto = s
            at = np.cumsum(np.array(sizes, dtype=np.int64))
        a, b = self.words.offs[k], self.words.offs[k + 1]
        i = np.searchsorted(self.words.start[a:b], at + self.offs[k], "right") + a - 2
        out = []
        for j in i.tolist():
            if j < a:
                out.append((0, 0, ""))
                continue
            one, two = int(self.one[j].view(np.int64)), int(self.two[j].view(np.int64))
            out.append((one, two, self.words.buf[self.words.start[j - 1 if two else j] : self.words.end[j]].tobytes()[-80:].decode(errors="replace")))
        return out

    def followed(self) -> np.ndarray:
        """Every occurrence of a pattern that another word follows."""
        last = np.zeros(len(self.one), dtype=bool)
        last[self.words.offs[1:][np.diff(self.words.offs) > 0] - 1] = True
        return np.concatenate([self.one[~last], self.two[~last & (self.two != 0)]])


_OUT = "row long, id long, base array<struct<start int, kind int, end int>>, found array<struct<start int, end int, seed string, one long, two long, said string, what string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    cand = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.string()), ("one", pa.int64()), ("two", pa.int64()), ("said", pa.string()), ("what", pa.string())])
    marks = re.compile("[0-9@_]")
    for b in batches:
        text = text_array(b, "__text")
        for i, j in slices(b, "__text"):
            base, found, near = [], [], None
            for k, t in enumerate(text.slice(i, j - i).to_pylist()):
                if marks.search(t) is None:
                    base.append([])
                    found.append([])
                    continue
                own = base_spans(t)
                base.append([{"start": a, "kind": n, "end": e} for a, n, e in own])
                spans = sorted(candidates(t, own), key=lambda x: x[:2])
                near = near or _Contexts(text.slice(i, j - i))
                found.append([
                    {"start": a, "end": e, "seed": seed, "one": one, "two": two, "said": said, "what": t[a:e].lower() if e - a <= 128 else hashlib.sha256(t[a:e].lower().encode()).hexdigest()}
                    for (a, e, seed), (one, two, said) in zip(spans, near.before(k, t, [s[0] for s in spans]), strict=True)
                ])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + j - i), pa.int64()), b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(cand))], names=["row", "id", "base", "found"])
            row += j - i


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """The bits of all patterns, as 64-bit words: a fixed size, however many patterns there are."""
    bit = F.col("pattern").bitwiseAND(F.lit((1 << BITS) - 1))
    words = patterns.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pattern & 63 AS INT))")).alias("b"))
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    got = words.toArrow()  # at most 1 << (BITS - 6) rows
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def occurrences(src: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of the patterns stands before any word in the texts of src."""
    bits = src.sparkSession.sparkContext.broadcast(_bitmap(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = bits.value, tv.Counts()
        for b in batches:
            text = text_array(b, "__text")
            for i, j in slices(b, "__text"):
                k = _Contexts(text.slice(i, j - i)).followed()
                low = k & np.uint64((1 << BITS) - 1)
                yield from counts.add(k[(known[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0])
        yield from counts.out()

    counted = src.select("__text").mapInArrow(run, "k long, c long").groupBy(F.col("k").alias("pattern")).agg(F.sum("c").alias("total"))
    return join_grouped(counted, patterns, ["pattern"]).select("pattern", "total")


def confident_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """edges: (pattern, what, seed or null), one for each occurrence; totals: (pattern, total). The staged patterns
    of the last round: (pattern, kind, score), score at least ACCEPT."""
    edges = edges.groupBy("pattern", "what").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = staged(join_grouped(edges, totals, ["pattern"]), "edges")
    known = staged(edges.where("seed is not null").groupBy("what").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    seeds, size, patterns = known, (0, 0.0), None
    for k in count():
        rated = join_grouped(edges, known, ["what"])
        by_kind = rated.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("score").alias("different"), F.max("total").alias("total"))
        now = by_kind.groupBy("pattern").agg(F.sum("hits").alias("hits"), F.sum("different").alias("different"), F.max("total").alias("total"), F.max(F.struct("hits", "kind"))["kind"].alias("kind"))
        score = F.least(F.col("hits") / F.col("total"), F.lit(1.0)) * F.col("different") / (F.col("different") + DOUBT)
        release(patterns)
        patterns = staged(now.select("pattern", "kind", score.alias("score")).where(F.col("score") >= ACCEPT), f"patterns-{k}")
        best = join_grouped(edges.where("seed is null"), patterns, ["pattern"]).groupBy("what").agg(F.max(F.struct("score", "kind")).alias("b"))
        new = best.select("what", "b.kind", "b.score").join(seeds.select("what"), "what", "left_anti")
        if known is not seeds:
            release(known)
        known = staged(seeds.unionByName(new), f"instances-{k}")
        grown = tuple(known.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if grown[0] == size[0] and grown[1] - size[1] <= SETTLED * grown[0]:
            release(edges, known, seeds)
            return patterns
        size = grown
    raise AssertionError


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base and more, arrays of struct<start, kind, end> in code points:
    the fixed forms (kind a number into KINDS), and the spans of secrets and of what accepted patterns
    discover (kind a name; of equally good patterns, the kind last by name).

    Null texts are empty; an empty text has no spans; null ids stay null; repeated rows are returned as often
    as they come; very long texts are searched whole. An empty table gives an empty result. Other columns
    of docs, whatever their names, are not touched."""
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    scan = staged(src.mapInArrow(_scan, _OUT), "candidates")
    one = scan.where(F.size("found") > 0).select("row", F.inline("found"))
    sure = learned_patterns(src, one)
    by = one.where("seed is null").withColumn("pattern", F.explode(F.array("one", "two"))).where("pattern <> 0")
    new = join_grouped(by, sure, ["pattern"]).groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    new = new.union(one.where(F.col("seed") == SECRET).select("row", "start", "end", F.lit(SECRET).alias("kind")))
    more = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))
    out = scan.select("row", "id", "base").join(more, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("more", none).alias("more"))


def learned_patterns(src: DataFrame, found: DataFrame) -> DataFrame:
    """The accepted patterns: src has the texts (__text), found their candidates as _scan gives them."""
    edges = found.select(F.explode(F.array("one", "two")).alias("pattern"), "what", "seed").where("pattern <> 0")
    distinct = edges.groupBy("pattern", "what").agg(F.lit(1).alias("n"))
    able = staged(distinct.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("pattern"), "able")
    totals = staged(occurrences(src, able), "totals")
    patterns = confident_patterns(edges, totals)
    release(able, totals)
    return patterns
