"""Near-duplicate documents by HyperMinHash.

Each distinct shingle set gets registers. A register is the minimum of the slot's permuted 64-bit shingle
hashes, stored as its count of leading zeros and the ``MANTISSA`` bits that follow the first one (Yu and Weber,
"HyperMinHash: MinHash in LogLog space"). Bands of registers bring candidates together; the Jaccard
estimate from the stored registers, corrected for those that agree by chance, discards hopeless pairs before any
text is read; the rest are confirmed on their full shingle sets. How many registers there are, and the least
estimate, follow from the similarity asked for: a link shares no band, or falls under the least estimate, with a
probability of ``MISS`` each.

Scale. Equal sets are one class from the start, so thousands of copies cost one row. In each band bucket all
members meet the smallest one only (a star, linear in the bucket), which then leaves the bucket; what is left and
still lies in several components meets its smallest one once more. After ``STARS`` such rounds a bucket of true
copies is one component. The rest, members of buckets that are alike but not linked, is compared wholly: first by
registers in blocks of ``BLOCK`` members, then those that may be linked by their texts in blocks bounded in
rows and bytes, as matrix products. Every step returns a spanning forest or the star's pairs, so the pairs of a
group are never rows, and a text is shipped at most once per band and star, unless it belongs to that rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import textvec as tv
from panelforge.llm.common import join_grouped, parallelism, release, slices, staged, text_array
from panelforge.llm.components import connected_components

MOST_SLOTS, MANTISSA, MISS, STARS = 96, 10, 1e-7, 2
#: Members of a block of registers; rows and bytes of a block of texts.
BLOCK, TEXTS, BYTES = 256, 256, 8 << 20
#: Ids are broadcast to the text scan up to this many rows (about 32 MB); beyond it, both sides shuffle.
MAX_BROADCAST_ROWS = 500_000

_seed = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, MOST_SLOTS), dtype=np.uint64)
_XOR, _MUL = _seed[0] * np.uint64(2) + np.uint64(1), _seed[1] * np.uint64(2) + np.uint64(1)


def layout(num: int, den: int) -> tuple[int, int]:
    """(registers per band, bands) with which links of similarity num / den share no band with probability MISS."""
    t = num / den
    if not 0 < t <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    for rows in (3, 2, 1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(t**rows))) if t < 1 else 1
        if rows * bands <= MOST_SLOTS:
            return rows, bands
    raise ValueError(f"{MOST_SLOTS} registers cannot find links of similarity {t:g}")


def least_estimate(num: int, den: int, slots: int) -> float:
    """The share of agreeing registers under which a link falls with probability MISS at most."""
    t, below, k = num / den, 0.0, 0
    while t < 1 and k < slots:
        below += math.exp(math.lgamma(slots + 1) - math.lgamma(k + 1) - math.lgamma(slots - k + 1) + k * math.log(t) + (slots - k) * math.log1p(-t))
        if below > MISS:
            break
        k += 1
    return k / slots if t < 1 else 1.0


def registers(values: np.ndarray, offs: np.ndarray, slots: int) -> np.ndarray:
    """(sets, slots) registers of the sets values[offs[i]:offs[i+1]], none of them empty."""
    out = np.empty((len(offs) - 1, slots), dtype=np.uint16)
    if not len(out):
        return out
    for k in range(slots):
        x = (values ^ _XOR[k]) * _MUL[k]
        x ^= x >> np.uint64(32)
        x *= _MUL[(k + 1) % MOST_SLOTS]
        x ^= x >> np.uint64(29)
        least = np.minimum.reduceat(x, offs[:-1]) | np.uint64(1)
        zeros = (64 - np.frexp(least.astype(np.float64))[1]).clip(0, 53)
        bits = (least << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[:, k] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that the registers of two disjoint sets of n and m elements agree."""
    total = np.zeros(np.broadcast(n, m).shape)
    for z in range(40):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1) if z < 39 else 0.0
        at = [(1 - lo) ** k - (1 - hi) ** k for k in (n, m)]
        total += at[0] * at[1]
    return total / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of every register row of a against every row of b."""
    agree = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        agree += a[:, k][:, None] == b[:, k][None, :]
    c = chance(n[:, None].astype(float), m[None, :].astype(float))
    return (agree / a.shape[1] - c) / (1 - c)


def _signatures(shingle: int, slots: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int64()), ("reg", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = text_array(batch, "__text"), batch.column(batch.schema.get_field_index("__id"))
            for i, j in slices(batch, "__text"):
                raw, at = tv.buffers(text.slice(i, j - i))
                w = tv.Words(raw, at)
                values, offs = tv.gram_sets(w, w.hashes(), shingle)
                n = np.diff(offs)
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                some = np.flatnonzero(n)
                reg: list[bytes] = [b""] * (j - i)
                if len(some):
                    starts = offs[:-1][some]
                    d1[some] = np.add.reduceat(tv.mix(values), starts)
                    d2[some] = np.add.reduceat(tv.mix(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), starts)
                    for row, r in zip(some, registers(values, np.append(starts, len(values)), slots), strict=True):
                        reg[row] = r.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.diff(at)), pa.array(reg, pa.binary())], schema=schema)

    return run


def _stacked(col: pa.Array, slots: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(len(col), slots)


def _likely(slots: int, floor: float):
    """Pairs (u, v) with their registers and sizes: those whose estimate is not under floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _stacked(b.column(2), slots), _stacked(b.column(3), slots)
                c = chance(b.column(4).to_numpy().astype(float), b.column(5).to_numpy().astype(float))
                keep = ((x == y).mean(axis=1) - c) / (1 - c) >= (floor - c) / (1 - c) - 1e-9
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(keep))

    return run


def _links(shingle: int, num: int, den: int):
    """Pairs (u, v) with their texts, those of one v one after the other: the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, star = None, np.zeros(0, np.uint64)
        for batch in batches:
            text = text_array(batch, "tu")
            for i, j in slices(batch, "tu"):
                w = tv.Words(*tv.buffers(text.slice(i, j - i)))
                values, offs = tv.gram_sets(w, w.hashes(), shingle)
                keep = np.zeros(j - i, dtype=bool)
                for k, v in enumerate(batch.column(1).slice(i, j - i).to_pylist()):
                    other = batch.column(3).slice(i + k, 1)
                    if (v, other[0]) != last:  # a repeated id may have several texts
                        last = (v, other[0])
                        s = tv.Words(*tv.buffers(other))
                        star = tv.gram_sets(s, s.hashes(), shingle)[0]
                    own = values[offs[k] : offs[k + 1]]
                    both = len(np.intersect1d(own, star, assume_unique=True))
                    keep[k] = both > 0 and den * both >= num * (len(own) + len(star) - both)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)], names=["u", "v"]).filter(pa.array(keep))

    return run


def _units(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first n_keys columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k)) for k in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked(values: np.ndarray, offs: np.ndarray, num: int, den: int) -> np.ndarray:
    """The Boolean matrix of links between the sets: den * |A & B| >= num * |A | B|. Sums of float32 products of
    4 M elements at most are exact."""
    k, n = len(offs) - 1, np.diff(offs)
    owner = np.repeat(np.arange(k), n)
    order = np.argsort(values, kind="stable")
    v, owner = values[order], owner[order]
    first = np.r_[True, v[1:] != v[:-1]]
    col = np.cumsum(first) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    owner, col = owner[keep], (np.cumsum(shared) - 1)[col[keep]]
    inter = np.zeros((k, k), dtype=np.float32)
    total, width = int(col[-1]) + 1 if len(col) else 0, max(1, (4 << 20) // max(k, 1))
    for a in range(0, total, width):
        i, j = np.searchsorted(col, [a, a + width])
        m = np.zeros((k, min(width, total - a)), dtype=np.float32)
        m[owner[i:j], col[i:j] - a] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    union = n[:, None] + n[None, :] - inter
    return den * inter >= num * union


def _forest(ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    label = np.arange(len(ids))
    while True:
        best = np.where(link, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            break
        label = new
    least = {c: min(ids[label == c]) for c in np.unique(label)}
    return [(int(i), int(least[c])) for i, c in zip(ids, label, strict=True) if i != least[c]]


def _edges(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        u, v = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _alike(slots: int, floor: float):
    """Units of (family, i, j, id, reg, n, component): a spanning forest of the members of different components
    whose estimate is not under floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, 3):
            ids, n, own = (unit.column(c).to_numpy() for c in ("id", "n", "component"))
            reg = _stacked(unit.column("reg").combine_chunks(), slots)
            c = chance(n[:, None].astype(float), n[None, :].astype(float))
            may = estimate(reg, reg, n, n) >= (floor - c) / (1 - c) - 1e-9
            yield from _edges(_forest(ids, may & (own[:, None] != own[None, :])))

    return run


def _confirm(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, 3):
            text = unit.column("text").combine_chunks()
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            ids = unit.column("id").to_numpy()
            w = tv.Words(*tv.buffers(text))
            values, offs = tv.gram_sets(w, w.hashes(), shingle)
            some = np.diff(offs) > 0
            if some.sum() < 2:
                continue
            ids, offs = ids[some], np.append(offs[:-1][some], len(values))
            yield from _edges(_forest(ids, _linked(values, offs, num, den)))

    return run


def _dealt(members: DataFrame, blocks, parts: int) -> DataFrame:
    """members (family, node, ...) dealt into ``blocks`` (a Column over rows and bytes of a family) and those
    into pairs of blocks: (family, i, j, part, id, ...); units of one family are of neighbouring parts."""
    sizes = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).withColumn("nb", blocks.cast("int")).select("family", "nb")
    dealt = join_grouped(members, sizes, ["family"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("b", "o", "nb")
    unit = F.pmod(F.xxhash64("family"), F.lit(parts)) + F.expr("CAST(j AS BIGINT) * (j + 1) DIV 2 + i")
    return dealt.withColumnRenamed("node", "id").withColumn("part", F.pmod(unit, F.lit(parts)).cast("int"))


def _gathered(dealt: DataFrame, parts: int) -> DataFrame:
    """Each unit in one task, its rows together, and the units of a family in different tasks."""
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("family", "i", "j")


def _families(crowded: DataFrame, name: str) -> DataFrame:
    """(node, family): members of buckets that share some, from rows (key, rep)."""
    star = crowded.groupBy("key").agg(F.min("rep").alias("v"))
    return connected_components(join_grouped(crowded, star, ["key"]).where("rep <> v").select(F.col("rep").alias("u"), "v"), name).withColumnRenamed("component", "family")


class _Search:
    """The steps of near_duplicates() over one table of classes (rep, n, size, reg)."""

    def __init__(self, src: DataFrame, classes: DataFrame, shingle: int, num: int, den: int):
        self.src, self.classes, self.shingle, self.num, self.den = src, classes, shingle, num, den
        self.rows, self.bands = layout(num, den)
        self.slots = self.rows * self.bands
        self.floor = least_estimate(num, den, self.slots)
        self.parts = 4 * parallelism(src.sparkSession)

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes, staged."""
        nodes = staged(nodes, "nodes")
        some = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_ROWS else nodes
        out = staged(self.src.join(some, F.col("__id") == F.col("node")).select("node", F.coalesce("__text", F.lit("")).alias("text")), "texts")
        release(nodes)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (u, v): estimated from registers, then confirmed on texts; staged."""
        side = lambda c: self.classes.select(F.col("rep").alias(c), F.col("reg").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
        both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "ru", "rv", "nu", "nv")
        likely = staged(both.mapInArrow(_likely(self.slots, self.floor), "u long, v long").distinct(), "likely")
        texts = self.texts(likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct())
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
        both = likely.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")
        out = staged(both.mapInArrow(_links(self.shingle, self.num, self.den), "u long, v long"), "links")
        release(likely, texts)
        return out

    def rest(self, crowded: DataFrame) -> DataFrame:
        """The links among members (key, rep, component) of one bucket and different components; staged."""
        family = _families(crowded, "family")
        own = crowded.select(F.col("rep").alias("node"), "component").distinct()
        of = self.classes.select(F.col("rep").alias("node"), "n", "size", "reg")
        members = family.join(own, "node").join(of, "node").select("family", "node", "n", "size", "component", "reg")
        dealt = _gathered(_dealt(members, F.ceil(F.col("rows") / BLOCK), self.parts), self.parts).select("family", "i", "j", "id", "n", "component", "reg")
        alike = connected_components(dealt.mapInArrow(_alike(self.slots, self.floor), "u long, v long"), "alike").withColumnRenamed("component", "family")
        of = self.classes.groupBy(F.col("rep").alias("node")).agg(F.max("size").alias("size"))
        texts = self.texts(alike.select("node").distinct())
        dealt = _dealt(alike.join(of, "node"), F.greatest(F.ceil(F.col("rows") / TEXTS), F.ceil(F.col("bytes") / BYTES)), self.parts)
        units = dealt.join(texts.withColumnRenamed("node", "id"), "id").select("family", "i", "j", "part", "id", "text")
        units = _gathered(units, self.parts).select("family", "i", "j", "id", "text")
        out = staged(units.mapInArrow(_confirm(self.shingle, self.num, self.den), "u long, v long"), "links")
        release(texts)
        return out

    def components(self) -> DataFrame:
        """(node, component) of all classes that are linked with another."""
        band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda b: F.xxhash64(b, F.substring("reg", b * (2 * self.rows) + 1, F.lit(2 * self.rows)))))
        keys = staged(self.classes.select("rep", band.alias("key")), "bands")
        centre = keys.groupBy("key").agg(F.min("rep").alias("v"), F.count("*").alias("c")).where("c > 1").select("key", "v")
        crowded = staged(join_grouped(keys, centre, ["key"]).withColumn("component", F.col("rep")).withColumn("cv", F.col("v")), "crowded")
        release(keys)
        found, comp = None, None
        for k in range(STARS + 1):
            if k < STARS:
                new = self.linked(crowded.where("component <> cv").select(F.col("rep").alias("u"), "v").distinct())
            else:
                new = self.rest(crowded.select("key", "rep", "component"))
            found = new if found is None else staged(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new), "found")
            release(comp)
            comp = staged(connected_components(found, f"links-{k}"), "components")
            release(new, found)
            if k == STARS:
                release(crowded)
                return comp
            # the star's centre has met all; what is left of a bucket and lies in several components goes on
            left = crowded.where("rep <> v").select("key", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
            centre = left.groupBy("key").agg(F.min(F.struct("rep", "component")).alias("s"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key", F.col("s.rep").alias("v"), F.col("s.component").alias("cv"))
            before, crowded = crowded, staged(join_grouped(left, centre, ["key"]), "crowded")
            release(before)
            if crowded.isEmpty():
                release(crowded)
                return comp
        raise AssertionError


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: (id_col long, n_shingles long, component_id long, kept boolean).

    Texts are lower-cased over A-Z and cut into words at white space; a text's set holds its distinct
    ``shingle``-word shingles, of a shorter text the whole word sequence. Two documents are linked if
    den * |A & B| >= num * |A | B|; component_id is the smallest id reachable over links. Similarities too low
    for MOST_SLOTS registers raise ValueError.

    Null and blank texts have an empty set and are linked with nothing. Rows with a null id are linked
    with nothing, have a null component_id and are kept. Repeated rows are returned as often as they
    come; rows of one id with different texts are one node, with the links of all. Very long texts are compared
    whole. Other columns of docs, whatever their names, are not touched. An empty table gives none. Ids are whole
    numbers."""
    rows, bands = layout(num, den)
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    sig = staged(src.mapInArrow(_signatures(shingle, rows * bands), "id long, n long, d1 long, d2 long, size long, reg binary"), "signatures")
    rep = staged(sig.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.any_value("size").alias("size"), F.any_value("reg").alias("reg")), "classes")
    comp = _Search(src, rep.select("rep", "n", "size", "reg"), shingle, num, den).components()
    out = join_grouped(sig.select("id", "n", "d1", "d2"), rep.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    at = F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), at).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )
