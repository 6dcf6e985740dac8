"""Repeated passages, found by winnowing over line hashes and deleted where they come again.

A line here is what a line break ends or, within one, a mark of punctuation with the space after it:
a few words, cut by nothing but its own end, so that a passage pasted into the middle of a paragraph
still has whole lines. Of every ``WINDOW`` neighbouring line hashes, and
of every fewer lines with ``min_words`` words, the least is a fingerprint (Schleimer, Wilkerson and Aiken,
"Winnowing", 2003), lines of ``SHORT`` words before shorter ones, and every line of ``LONG`` words is one: two
copies of a run of whole lines with ``min_words`` words always share one. All positions of a fingerprint (a
64-bit line hash) are joined with its first one; the neighbours up to the next window, of which each fingerprint
carries chained hashes, extend the match on both sides. Where they differ, the fingerprint together with its
next one, two, ... neighbours on a side is a key in its turn, joined with the first position of that key: so a
line that stood elsewhere before hides no passage. Runs of covered lines with at least ``min_words`` words are
deleted, the first copy stays. Chained hashes have 32 bits for each depth: where a match ends, one line more is
taken for equal with a probability of 2**-32.

Scale. Only DataFrame functions. The text is scanned twice and joined once with the runs to delete; in
between, rows are of a few dozen bytes, one for about every third line. A passage that a third of all
documents hold costs one row per copy: the first position is a minimum with partial aggregation, and
the join with it has one row per key on one side, so adaptive execution can split a hot key's rows.
The runs are broadcast up to a checked size; beyond it, documents and runs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import join_grouped, release, staged

WINDOW, LONG, SHORT = 5, 20, 3
#: Neighbours that a fingerprint carries on each side, and their columns.
REACH, CARRIED = WINDOW - 1, ("l1", "l3", "r1", "r3")
#: More than the words of a window's lines, of which each counts ``min_words`` at most.
LINE = 1 << 20
_MARKS = [m + " " for m in ".!?,;:|"] + ["\n", "。", "！", "？", "，", "；"]
_LINES = r"(?<=\n)|(?<=[.!?,;:|] )|(?<=[。！？，；])"
_CUT = "\x01"
#: Documents with runs to delete are broadcast up to so many bytes of runs.
MAX_BROADCAST_BYTES = 32 << 20


def lines(text: Column) -> Column:
    """The lines of a text, each with what ends it; joined without separator they are the text. Plain
    replacements and a split at one character do what a regular expression would do ten times slower;
    a text that has this character is left to the regular expression."""
    cut = text
    for m in _MARKS:
        cut = F.replace(cut, F.lit(m), F.lit(m + _CUT))
    return F.when(F.contains(text, F.lit(_CUT)), F.split(text, _LINES)).otherwise(F.split(cut, _CUT))


def _words(t: Column) -> Column:
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1).cast("int")


def _order(h: Column, n: Column) -> Column:
    """What lines compete by: 53 bits of the hash and the word count in the last 8; short lines come after longer
    ones, blank ones last."""
    return F.when(n == 0, F.lit(1 << 62)).otherwise(F.shiftleft(F.shiftrightunsigned(h, 11), 8).bitwiseOR(F.least(n, F.lit(255)).cast("long")) + F.when(n >= SHORT, 0).otherwise(1 << 61))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, q): of each document the hashes of its lines, and _order() of them with REACH nulls on each side."""
    src = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(lines(F.col(text_col)), lambda u: F.btrim(u, F.lit(" \n\r\t"))).alias("t"))
    src = src.select("id", F.transform("t", _words).alias("n"), F.transform("t", lambda t: F.xxhash64(t)).alias("h"))
    none = F.array(*[F.lit(None).cast("long")] * REACH)
    return src.select("id", "h", F.concat(none, F.zip_with("h", "n", _order), none).alias("q"))


def _apart(c: Column) -> Column:
    """True, for a number that is not negative. Operators with a lambda are compiled by expression, in methods that the JIT
    takes and with common parts once; without it, all operators of a stage are one method, too large for it."""
    return F.exists(F.array(c), lambda x: x >= 0)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, pos, key, n, words, l1, l3, r1, r3), one row per fingerprint: its place and line hash, its words, those
    of its neighbours (a byte each, left ones first, the nearest last of a side), and of each side two longs
    of hashes: 32 bits of the nearest neighbour, of the nearest two, three and four; 0 where there are no more."""
    src = _hashed(docs, id_col, text_col)
    q = lambda d: F.col(f"q{d}")
    zipped = F.arrays_zip(F.col("h").alias("key"), F.sequence(F.lit(0), F.size("h") - 1).alias("pos"), *[F.slice("q", REACH + 1 + d, F.size("h")).alias(f"q{d}") for d in range(-REACH, REACH + 1)])
    # outer: else a filter on the arrays' size is put before, and they are made once more for it
    flat = src.select("id", F.inline_outer(zipped)).withColumn("own", F.coalesce(q(0), F.lit(1 << 62))).where(F.col("own") < 1 << 62)
    count = lambda x: F.when(x < 1 << 62, x.bitwiseAND(F.lit(255))).otherwise(F.lit(0).cast("long"))

    def free(sign: int) -> Column:
        """The neighbours in a row, from the nearest, that are no less: their words, and LINE for each."""
        held, below = F.lit(0).cast("long"), []
        for d in range(1, REACH + 1):
            below.append((q(sign * d), held))
            held = held + F.least(count(q(sign * d)), F.lit(min_words).cast("long")) + LINE
        out = held
        for other, upto in reversed(below):
            out = F.when(F.col("own") > F.coalesce(other, F.lit(-1)), upto).otherwise(out)
        return out

    flat = flat.withColumn("n", count(F.col("own"))).withColumn("free", free(-1) + free(1))
    flat = flat.where(((F.col("n") >= LONG) | (F.col("free") >= REACH * LINE) | (F.col("free") % LINE + F.least(F.col("n"), F.lit(min_words)) >= min_words)) & _apart(F.col("pos")))

    def chained(sign: int) -> list[Column]:
        upto = [F.when(q(sign * d).isNotNull(), F.xxhash64(*[q(sign * k) for k in range(1, d + 1)]).bitwiseAND(F.lit((1 << 32) - 2)) + 1).otherwise(F.lit(0).cast("long")) for d in range(1, REACH + 1)]
        return [F.shiftleft(a, 32).bitwiseOR(b) for a, b in zip(upto[::2], upto[1::2], strict=True)]

    words = F.lit(0).cast("long")
    for d in [*range(-REACH, 0), *range(REACH, 0, -1)]:
        words = F.shiftleft(words, 8).bitwiseOR(count(q(d)))
    return flat.select("id", "pos", "key", F.when(_apart(F.col("pos")), F.col("n").cast("int")).alias("n"), words.alias("words"), *[c.alias(x) for c, x in zip(chained(-1) + chained(1), CARRIED, strict=True)])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """(id long, runs array<struct<first int, last int>>): for each document with lines to delete, their
    0-based ranges among lines(text). A match is of at least two lines or SHORT words."""
    prints = staged(fingerprints(docs, id_col, text_col, min_words), "fingerprints")
    first = prints.groupBy("key").agg(F.min(F.struct("id", "pos", *CARRIED)).alias("c"), F.count("*").alias("times")).where("times > 1").select("key", "c")
    m = join_grouped(prints, first, ["key"]).where("id > c.id or (id = c.id and pos > c.pos)")

    def chain(side: str, d: int, of: str = "") -> Column:
        """The hash of a side's d nearest neighbours, 0: there are fewer."""
        return F.shiftrightunsigned(F.col(f"{of}{side}{d - (d - 1) % 2}"), 32 if d % 2 else 0).bitwiseAND(F.lit((1 << 32) - 1))

    for side in "lr":
        out = F.lit(REACH)
        for d in range(REACH, 0, -1):
            out = F.when((chain(side, d) == 0) | (chain(side, d) != chain(side, d, "c.")), d - 1).otherwise(out)
        m = m.withColumn(f"e{side}", out)
    apart = F.col("id") != F.col("c.id")
    m = m.withColumn("whole", apart | (F.col("pos") - F.col("el") > F.col("c.pos") + F.col("er")))
    m = staged(m.drop("c"), "matches")
    release(prints)

    # where a side agrees with the first position for fewer lines than are carried, an other position may agree
    # for more: each further depth is a key of its own, and its first position is found among those that have it
    deeper = [
        F.when((~F.col("whole") | (F.col(f"e{side}") < d)) & (chain(side, d) > 0), F.struct(F.lit(side).alias("side"), F.lit(d).alias("depth"), F.xxhash64("key", F.lit(side), F.lit(d), chain(side, d)).alias("context")))
        for side in "lr" for d in range(1, REACH + 1)
    ]
    more = m.where(~F.col("whole") | (F.col("el") < REACH) | (F.col("er") < REACH)).select("id", "pos", "n", "words", F.inline_outer(F.array(*deeper))).where("side is not null")
    earliest = more.groupBy("context").agg(F.min(F.struct("id", "pos")).alias("c"), F.count("*").alias("times")).where("times > 1").select("context", "c")
    more = join_grouped(more, earliest, ["context"]).where("id > c.id or (id = c.id and pos > c.pos + depth)")
    spans = m.where("whole and (el + er > 0 or n >= 6)").select("id", "pos", "el", "er", "n", "words")
    depth = lambda side: F.when(F.col("side") == side, F.col("depth")).otherwise(0)
    spans = spans.union(more.select("id", "pos", depth("l").alias("el"), depth("r").alias("er"), "n", "words"))
    spans = spans.groupBy("id", "pos").agg(F.max("el").alias("el"), F.max("er").alias("er"), F.max("n").alias("n"), F.max("words").alias("words"))
    # covered lines of a document, from span to span: what lies past the end of all before is new
    spans = spans.withColumns({"start": F.col("pos") - F.col("el"), "end": F.col("pos") + F.col("er")})
    by = Window.partitionBy("id").orderBy("start", "pos")
    spans = spans.withColumn("upto", F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("start") > F.col("upto") + 1, 1).otherwise(0)).over(by))

    def new(side: str, d: int) -> Column:
        at = F.col("pos") + (d if side == "r" else -d)
        n = F.shiftrightunsigned("words", 8 * (d - 1) + (8 * REACH if side == "l" else 0)).bitwiseAND(F.lit(255))
        return F.when((F.col(f"e{side}") >= d) & (at > F.col("upto")), n).otherwise(F.lit(0).cast("long"))

    fresh = F.when(F.col("pos") > F.col("upto"), F.col("n").cast("long")).otherwise(F.lit(0).cast("long"))
    for side in "lr":
        for d in range(1, REACH + 1):
            fresh = fresh + new(side, d)
    runs = spans.groupBy("id", "run").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum(fresh).alias("words")).where(F.col("words") >= min_words)
    out = staged(runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "runs")
    release(m)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30, runs_col: str = "runs_deleted") -> DataFrame:
    """docs with every later repeated run of at least ``min_words`` words cut out of text_col, the other
    columns as they are, and one more: runs_col, the ranges cut (null if none). If docs has a column of that name,
    it is kept and the new one gets "_" appended until its name is free.

    The first copy, by id and then by place, always stays. Null and empty texts, and rows with a null id,
    are returned as they are; very long texts are cut like all others. id_col, whole numbers, identifies a
    document: repeated rows are one document, are not deleted for each other and all get the same cuts; where their
    texts differ, each is cut at the places found in any. An empty table gives an empty result."""
    while runs_col in docs.columns:
        runs_col += "_"
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("id").alias("__id"), F.col("runs").alias("__runs"))
    size = runs.agg(F.coalesce(F.sum(16 + 8 * F.size("__runs")), F.lit(0))).first()[0]
    out = docs.join(F.broadcast(runs) if size <= MAX_BROADCAST_BYTES else runs, F.col(id_col).cast("long") == F.col("__id"), "left")
    kept = F.filter(lines(F.col(text_col)), lambda u, i: ~F.exists("__runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    rest = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*[text.alias(c) if c == text_col else x for c, x in zip(docs.columns, rest, strict=True)], F.col("__runs").alias(runs_col))
