"""Near copies, repeated passages, fingerprints and benchmark matches against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontam, linededup, neardup, simhash
from panelforge.llm import textvec as tv
from panelforge.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, component_id long, id string"


def words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def corpus(seed=5):
    """Texts with exact and near copies, short, empty and null ones."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 90))) for _ in range(60)]
    for _ in range(6):
        base = words(rng, 120)
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), "", "  \n", None, "one", "ONE", "one two", "straße É", "straße É", "straße é"]
    rng.shuffle(texts)
    return [(3 * k + 1, t, "en", 7, "clash") for k, t in enumerate(texts)] + [(None, "one", "en", 7, "clash"), (1, texts[0], "en", 7, "again")]


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, num):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=n, num=num).collect()
    want = brute_components(rows, n, num, 100)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """More members than a block, and joined by shuffles instead of broadcasts."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "TEXTS", 16)
    monkeypatch.setattr(neardup, "MAX_BROADCAST_ROWS", 0)
    rng = random.Random(2)
    base = words(rng, 90)
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(90)] = f"y{rng.randrange(9999)}"
        rows.append((k, " ".join(w), "", 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, num=85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85, 100).items()}


@pytest.mark.parametrize("stars", [0, 1])
def test_near_duplicates_beyond_the_stars(spark, monkeypatch, stars):
    """Templates that share most shingles but are linked in chains only, in blocks of a few members."""
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "TEXTS", 8)
    rng = random.Random(7)
    base = words(rng, 150)
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([2, 4, 7, 9])):
            w[rng.randrange(150)] = f"z{rng.randrange(9999)}"
        rows.append((1000 - k, " ".join(w), "", 0, ""))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, num=85).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85, 100).items()}
    assert got == want and 3 < len(set(want.values())) < 80


def test_register_layout():
    for num in (20, 50, 70, 80, 85, 95, 100):
        rows, bands = neardup.layout(num, 100)
        assert rows * bands <= neardup.MOST_SLOTS and (1 - (num / 100) ** rows) ** bands <= neardup.MISS
        floor = neardup.least_estimate(num, 100, rows * bands)
        assert floor <= num / 100
    for num in (0, 5, 101):
        with pytest.raises(ValueError):
            neardup.layout(num, 100)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    x, y = np.unique(a[:3000]), np.unique(a[1000:])
    reg = neardup.registers(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 48)
    est = neardup.estimate(reg[:1], reg[1:], np.array([len(x)]), np.array([len(y)]))[0, 0]
    assert abs(est - 0.5) < 0.25
    assert neardup.estimate(reg[:1], reg[:1], np.array([len(x)]), np.array([len(x)]))[0, 0] == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        if u is not None and u != v:
            x, y = find(u), find(v)
            parent[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_vectors():
    import pyarrow as pa

    texts = ["A b  c\n", "", "b A", "éÉ\x0bx", "q" * 600_000 + " b"]
    w = tv.Words(*tv.buffers(pa.array(texts)))
    got = [[w.word(k) for k in range(w.offs[i], w.offs[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[3] == h[-1] and len(set(h.tolist())) == 6


def passages(seed=9):
    rng = random.Random(seed)

    def prose(n):
        out = []
        while len(out) < n:
            s = words(rng, rng.randrange(3, 12), 100_000)
            out += s[:-1] + [s[-1] + rng.choice([".", ".", "!", ","])]
        return out[:n]

    shared = [" ".join(prose(90)) + "." for _ in range(3)]
    rows, holds = [], defaultdict(list)
    for i in range(40):
        w = prose(120)
        text = " ".join(w)
        if i % 4 == 0:
            p = shared[i % 3]
            text = " ".join(w[:50]) + rng.choice([" ", "\n"]) + p + rng.choice([" ", "\n"]) + " ".join(w[50:])
            holds[p].append(i)
        rows.append((i, text, "en", 1, "x"))
    return rows, holds


def test_line_dedup(spark):
    rows, holds = passages()
    odd = [(100, None, "en", 1, "x"), (101, "", "en", 1, "x"), (None, rows[0][1], "en", 1, "x"), (102, "a \x01 b. " + rows[0][1], "en", 1, "x"), (103, rows[1][1], "en", 1, "x"), (1, rows[1][1], "en", 1, "again")]
    out = linededup.line_dedup(spark.createDataFrame(rows + odd, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "component_id", "id", "runs_deleted"]
    got = out.collect()
    by = {r["doc_id"]: r["text"] for r in got if r["id"] == "x"}
    before = {r[0]: r[1] for r in rows}
    for p, ids in holds.items():
        kept = p.split()[10:-10]
        for i in ids[1:]:
            assert " ".join(kept) not in " ".join(by[i].split()) and len(by[i].split()) < 120 + 30
        assert by[ids[0]] == before[ids[0]]
    assert all(by[i] == before[i] for i in before if i % 4)
    assert by[100] is None and by[101] == "" and by[None] == before[0]
    assert "a \x01 b. " in by[102] and len(by[102]) < len(before[0]) / 2
    assert by[103] == "" and [r["text"] for r in got if r["doc_id"] == 1] == [before[1]] * 2
    assert linededup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_past_an_earlier_line(spark):
    """Every line of the passage stood in an earlier document in another context."""
    rng = random.Random(12)
    prose = lambda n: " ".join(words(rng, n, 100_000)) + ". "
    passage = [prose(5) for _ in range(9)]
    rows = [(1, "".join(x + prose(9) + prose(8) for x in passage), "en", 1, "x")]
    rows += [(i, prose(9) + prose(8) + "".join(passage) + prose(9) + prose(8), "en", 1, "x") for i in (2, 3, 4)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert got[i] == (t.replace("".join(passage), "") if i > 2 else t)


def brute_runs(rows, min_words=30):
    """Per document, which words lie in a run of whole lines with min_words words or more that stood before."""
    own, where = {}, defaultdict(list)
    for i, t in rows:
        own[i] = [x.strip(" \n\r\t") for x in re.split(linededup._LINES, t)]
    for i in sorted(own):
        for k, x in enumerate(own[i]):
            where[x].append((i, k))
    due = {}
    for i, ls in own.items():
        hit = set()
        for k, x in enumerate(ls):
            for j, m in where[x]:
                if (j, m) >= (i, k):
                    break
                if k and m and ls[k - 1] == own[j][m - 1]:
                    continue
                n = 0
                while k + n < len(ls) and m + n < len(own[j]) and ls[k + n] == own[j][m + n] and (j != i or m + n < k):
                    n += 1
                if sum(len(y.split()) for y in ls[k : k + n]) >= min_words:
                    hit |= set(range(k, k + n))
        due[i] = hit
    return own, due


def test_line_dedup_against_brute_force(spark):
    """Passages among very common lines; what is cut, and what is not, word by word."""
    rng = random.Random(21)
    common = [" ".join(words(rng, rng.randrange(1, 9), 3000)) + "." for _ in range(60)]
    fresh = lambda: " ".join(words(rng, rng.randrange(1, 14), 10**6)) + rng.choice([".", ",", "!"])
    passages = [[rng.choice(common) if rng.random() < 0.5 else fresh() for _ in range(rng.randrange(6, 18))] for _ in range(25)]
    rows = []
    for i in range(150):
        body = [rng.choice(common) if rng.random() < 0.4 else fresh() for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n"]).join(body)))
    own, due = brute_runs(rows)
    out = {r["doc_id"]: r["runs_deleted"] or [] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = lambda i, ks: sum(len(own[i][k].split()) for k in ks)
    cut = {i: {k for r in out[i] for k in range(r["first"], r["last"] + 1)} for i in own}
    wanted, missed = sum(size(i, due[i]) for i in own), sum(size(i, due[i] - cut[i]) for i in own)
    assert wanted > 3000 and missed <= 0.1 * wanted
    # what is cut besides was a repeated run that others continue, or stands between two of them
    assert sum(size(i, cut[i] - due[i]) for i in own) <= 0.05 * wanted


def test_line_dedup_of_odd_tables(spark):
    rows, _ = passages()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("runs_deleted", F.lit("mine")).withColumn("runs_deleted_", F.lit(1))
    out = linededup.line_dedup(df)
    assert out.columns == [*df.columns, "runs_deleted__"] and {r["runs_deleted"] for r in out.collect()} == {"mine"}
    text = " ".join(f"word{k % 1000} and w{k}." for k in range(150_000))
    long = spark.createDataFrame([(1, text), (2, "Other words. " + text), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(long).collect()}
    assert got == {1: text, 2: "Other words. ", 3: "x" * 3_000_000}


def test_line_dedup_of_few_lines(spark):
    """Passages of one to four lines, and of blank lines between, with foreign lines around them."""
    rng = random.Random(13)
    prose = lambda n, end=". ": " ".join(words(rng, n, 100_000)) + end
    passages = [[prose(-(-30 // n)) for _ in range(n)] for n in (1, 2, 3, 4) for _ in range(15)] + [[prose(16, "\n"), "\n", "\n", prose(16)] for _ in range(15)]
    rows = [(2 * k + i, "".join(prose(rng.randrange(3, 12)) for _ in range(5)) + "".join(p) + "".join(prose(rng.randrange(3, 12)) for _ in range(5)), "en", 1, "x") for k, p in enumerate(passages) for i in (0, 1)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert got[i] == (t.replace("".join(passages[i // 2]), "") if i % 2 else t)


def test_lines_rejoin(spark):
    texts = ["a. b, c! d\n\ne", "x" * 5000 + ". y", "no end", "。你好。再见", " . , ! ", "a\x01. b", "end. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.lines(F.col("t")).alias("u"))
    for r in df.collect():
        assert "".join(r["u"]) == r["t"]
        assert [x for x in r["u"] if x] == [x for x in re.split(linededup._LINES, r["t"]) if x]


def test_line_dedup_by_shuffle(spark, monkeypatch):
    rows, _ = passages()
    a = {tuple(r) for r in linededup.line_dedup(spark.createDataFrame(rows, SCHEMA)).drop("runs_deleted").collect()}
    monkeypatch.setattr(linededup, "MAX_BROADCAST_BYTES", -1)
    assert a == {tuple(r) for r in linededup.line_dedup(spark.createDataFrame(rows, SCHEMA)).drop("runs_deleted").collect()}


def test_fingerprints(spark):
    rows = [r for r in corpus() if r[0] is not None and r[4] != "again"]
    got = {r["doc_id"]: r for r in simhash.document_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids = sorted(got)
    text = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for k, i in enumerate(ids):
        a, b = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        assert prints.setdefault(a, got[i]["fp"]) == got[i]["fp"]
        other = got[ids[(k + 1) % len(ids)]]["fp"]
        assert got[i]["near_next"] == 1 - bin((got[i]["fp"] ^ other) & ((1 << 64) - 1)).count("1") / 64
    one = simhash.document_fingerprints(spark.createDataFrame([(4, "ab cd", "", 0, "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert simhash.document_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = simhash.document_fingerprints(spark.createDataFrame(corpus(), SCHEMA))
    assert odd.count() == len(corpus())


def test_fingerprints_by_a_plain_vote():
    import math
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(23)
    for text in [" ".join(words(rng, n, 40)) for n in (1, 2, 5, 60, 400)] + ["É é É", ""]:
        w = tv.Words(*tv.buffers(pa.array([text])))
        h = w.hashes()
        terms = Counter(h.tolist()) + Counter(tv.grams(h, 2).tolist() if len(h) > 1 else [])
        votes = [sum((1 + math.log(c)) * (1 if t >> k & 1 else -1) for t, c in terms.items()) for k in range(64)]
        assert int(simhash.fingerprints([text])[0]) == sum(1 << k for k in range(64) if votes[k] > 1e-4)


def test_fingerprints_of_a_hot_id(spark):
    """More rows of one id, and of none, than a range holds; followers are still the next by id and text hash."""
    rows = [(5 if k % 3 else None, f"text {k} of many words {k * k}") for k in range(600)] + [(k, f"other {k}") for k in range(10, 90)] + [(700, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], h[r[1]]))
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in simhash.document_fingerprints(df).collect()) == want


def test_near_classes(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = base + [b ^ sum(1 << rng.randrange(62) for _ in range(k % 6)) for k, b in enumerate(base * 4)] + [base[0]] * 5
    df = spark.createDataFrame([(1000 - k, p) for k, p in enumerate(prints)] + [(7, None), (None, base[1])], "doc_id long, fp long")
    got = {r["fp"]: r for r in simhash.near_classes(df, df.where(F.col("fp").isin(base))).collect()}
    first = {}
    for k, p in enumerate(prints):
        first[p] = 1000 - k
    assert {p: r["class"] for p, r in got.items()} == first
    every = [*prints, base[1]]
    for b in first:
        near = [p for p in every if bin(b ^ p).count("1") <= 3]
        assert (got[b]["n_within"], got[b]["near"]) == ((len(near), sorted({first[p] for p in near})) if b in base else (None, None))


def test_benchmark_matches(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, n, 60)), "clash") for k, n in enumerate((25, 14, 10, 6, 1, 0, 30))] + [(9, None, ""), (None, "w1 w2", ""), (0, "extra item words here of more than ten to be found", "")]
    rows = []
    for i in range(50):
        w = words(rng, 40, 60)
        if i % 3 == 0:
            own = re.findall(r"\w+", rng.choice(items[:4])[1])
            a = rng.randrange(max(1, len(own) - 9))
            w[10 : 10 + len(own) - a] = own[a : a + 12]
        rows.append((i, ", ".join(w).upper() if i % 2 else " ".join(w), "en", 0, ""))
    rows += [(60, None, "en", 0, ""), (61, "", "en", 0, ""), (62, "w1", "en", 0, ""), (62, "w1", "en", 0, "")]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    pat = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = defaultdict(set)
    for i, t, _ in items:
        w = pat.findall((t or "").encode().lower())
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w and i is not None else 0):
            win[tuple(w[k : k + min(10, len(w))])].add(i)
    rows += [(63, rows[0][1], "en", 0, "")] * 2 + [(63, rows[3][1], "en", 0, ""), (None, rows[0][1], "en", 0, ""), (None, "w1 of no item", "en", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = []
    for i, t, *_ in rows:
        w = pat.findall((t or "").encode().lower())
        hit, found = set(), set()
        for a in range(len(w)):
            for b in range(a + 1, min(a + 10, len(w)) + 1):
                if tuple(w[a:b]) in win:
                    hit |= set(range(a, b))
                    found |= win[tuple(w[a:b])]
        want.append((str(i), len(w), len(hit), sorted(found)))
    for limit in (256 << 20, 3000):
        m = decontam.benchmark_matches(docs, bench, max_block_bytes=limit)
        got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in m.select("*", decontam.hit_words().alias("n_hit")).collect()]
        assert sorted(got) == sorted(want)
        clean = sorted(str(r["doc_id"]) for r in decontam.decontaminate(docs, bench, max_block_bytes=limit).collect())
        assert clean == sorted(i for i, _, n, _ in want if n == 0)
    assert decontam.benchmark_matches(docs, bench.where("false")).where(F.size("items") > 0).count() == 0
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0


def test_longest_matches(spark):
    """The longest match of each item with its place, the first of equals; a prompt that many items share."""
    rng = random.Random(16)
    one, prompt = words(rng, 40, 5000), " ".join(words(rng, 12, 5000))
    items = [(1, " ".join(one))] + [(k, f"{prompt} {' '.join(words(rng, 5, 5000))}") for k in range(10, 400)]
    text = " ".join(["a", *one[3:15], "b", *one[10:30], "c", *one[10:30], prompt] + [prompt] * 30)
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for places in (decontam.PLACES, 50):
        old, decontam.PLACES = decontam.PLACES, places
        try:
            index = decontam._Index([(i, t.encode()) for i, t in items], 10)
            import pyarrow as pa

            _, lists = decontam._search(index, pa.array([text]))
        finally:
            decontam.PLACES = old
        r = {c: x[0].as_py() for (c, _), x in zip(decontam.FOUND, lists, strict=True)}
        got = {i: (a, b, n) for i, a, b, n in zip(r["items"], r["doc_start"], r["item_start"], r["length"], strict=True)}
        assert got == {1: (14, 10, 20)} | {k: (55, 0, 12) for k in range(10, 400)}
        assert list(zip(r["hit_start"], r["hit_length"], strict=True)) == [(1, 12), (14, 20), (35, 20 + 12 * 31)]
    assert decontam.benchmark_matches(docs, bench).first()["items"] == [1, *range(10, 400)]
