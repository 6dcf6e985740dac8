"""Toxicity, quality, language model, personal data, packing, URLs and the pipeline on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import packing, pii, quality, suffixtree, toxicity, urlfilter
from panelforge.llm import queries as Q
from panelforge.llm.common import staged

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, severity string, score string"


def prose(rng, n, extra=()):
    w = [f"w{rng.randrange(300)}" for _ in range(n)]
    for e in extra:
        w[rng.randrange(n)] = e
    return " ".join(w)


def labelled(spark, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(rng, 60, [rng.choice(["vile", "grubby", "rotters", "rotting"]) for _ in range(1 + i % 4)] if bad else ()), "s", "t"))
        marks.append((i, int(bad), "x"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int, text string")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 300"), fit_rows=1000)
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["toxic_probability"] >= 0.5) == (i % 5 == 0) for i in range(300, 400))
    mean = lambda k: np.mean([got[i]["severity"] for i in range(0, 400, 5) if i % 4 == k])
    assert mean(0) < mean(3)
    odd = spark.createDataFrame([(None, "vile rotters grubby", "", ""), (1, None, "", ""), (1, "", "", ""), (2, "vile " * 50_000, "", "")], DOCS)
    assert toxicity.score(odd, model).count() == 4
    left = toxicity.reject_toxic(odd, model)
    assert left.columns == odd.columns and sorted(r["text"] or "" for r in left.collect()) == ["", ""]
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.reject_toxic(docs, none).count() == 400
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 2)) < 0.5
    grade = np.digitize(2 * x[:, 0] + rng.logistic(size=4000), [-1, 1, 3])
    w, cuts = toxicity.fit_ordinal(toxicity.Sparse.of([np.flatnonzero(r).tolist() for r in x], 2), grade)
    assert np.allclose(w, [2, 0], atol=0.3) and np.allclose(cuts, [-1, 1, 3], atol=0.4)


def test_held_out_grades():
    """Rows with more evidence get higher grades, by models that have not seen them."""
    rng = np.random.default_rng(2)
    found, strength = [], []
    for i in range(1200):
        k = 1 + i % 3 if i % 4 == 0 else 0
        strength.append(k)
        found.append(sorted({*rng.choice(20, k, replace=False).tolist(), *(20 + rng.choice(30, 4, replace=False)).tolist(), *(rng.choice(20, 1).tolist() if rng.random() < 0.05 else [])}))
    toxic = (np.array(strength) > 0).astype(int)
    grade = toxicity.held_out_grades(toxicity.Sparse.of(found, 50), toxic)
    assert (grade[toxic == 0] == 0).all() and set(grade[toxic == 1]) == {1, 2, 3}
    means = [np.mean([g for g, s in zip(grade, strength, strict=True) if s == k]) for k in (1, 2, 3)]
    assert means[0] < means[1] < means[2]
    assert (toxicity.held_out_grades(toxicity.Sparse.of([[0], [], []], 1), np.array([1, 0, 0])) == [1, 0, 0]).all()


def test_toxicity_on_held_out_labels(spark):
    """Half of the labels of the given tables, learnt from the others; the smallest ones have five toxic labels in a half."""
    for sf, least in (("sf0.001", 0.0), ("sf0.1", 0.85)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        half = F.crc32(F.col("doc_id").cast("string")) % 2
        out = toxicity.score(docs, toxicity.fit(docs, labels.where(half == 0))).join(labels.where(half == 1), "doc_id").select("toxic", "toxic_probability").collect()
        caught = np.mean([r["toxic_probability"] >= 0.5 for r in out if r["toxic"]])
        left = np.mean([r["toxic_probability"] < 0.5 for r in out if not r["toxic"]])
        print(sf, "caught", caught, "clean left", left, len(out))
        assert caught >= least and left >= 0.99


def test_quality(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        lines = [prose(rng, rng.randrange(4, 20)).capitalize() + "." for _ in range(1 + i % 7)]
        if bad:
            lines = [x.replace(" ", "### ").upper() if rng.random() < 0.9 else x for x in lines] + ["BUY!! NOW!! $$$ ||| !!!"]
        rows.append((i, "\n".join(lines), "s", "t"))
        marks.append((i, int(not bad)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels.where("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 > 0) for i in range(200, 300)]) > 0.95
    odd = spark.createDataFrame([(None, "a\n\n\nb", "", ""), (1, None, "", ""), (1, "", "", ""), (2, "line\n" * 20_000, "", "")], DOCS)
    out = [r["score"] for r in quality.score(odd, model).collect()]
    assert len(out) == 4 and all(0 <= s <= 1 for s in out)
    assert [r["score"] for r in quality.score(odd, quality.fit(docs, labels.where("quality = 1"))).collect()] == [0.5] * 4


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    u, t = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        weight[tuple(y)] = math.exp(sum(u[i] * y[i] for i in range(5)) + sum(t[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(5)]
    assert np.allclose(quality.marginals(u, t, np.array([0, 5])), want)


def test_line_features_are_local():
    import pyarrow as pa

    texts = ["A b\nC!! d d", "", "x", "\n"]
    x, length, lines = quality.line_features(pa.array(texts))
    assert lines.tolist() == [0, 2, 3, 4, 6] and length.tolist() == [4, 8, 1, 2, 1, 1]
    for k, t in enumerate(texts):
        alone, _, _ = quality.line_features(pa.array([t]))
        assert np.allclose(alone, x[lines[k] : lines[k + 1]])


def test_suffix_tree(spark):
    rng = random.Random(3)
    follow = {f"a{k}": f"b{k}" for k in range(10)}
    rows = []
    for i in range(300):
        w = []
        for _ in range(30):
            w.append(f"a{rng.randrange(10)}" if not w or w[-1] not in follow or rng.random() < 0.05 else follow[w[-1]])
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w), "s", "t"))
    rows += [(500, None, "", ""), (501, "", "", ""), (501, "", "", ""), (None, "unseen words a1 b1", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    tree, counts = suffixtree.train(docs.where("doc_id < 250"))
    got = suffixtree.score(docs, tree, counts).collect()
    assert len(got) == len(rows)
    toks = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    c = Counter(x for i, t, *_ in rows if i is not None and i < 250 for x in toks(t))
    n, v = sum(c.values()), len(c)
    want = {(i, len(toks(t)), sum(c[x] > 0 for x in toks(t)), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 8)) for i, t, *_ in rows}
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8)) for r in got} == want and {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["doc_id"] is not None and 250 <= r["doc_id"] < 500]
    assert sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)
    assert len(tree.levels[0]["state"]) >= 10
    blank, none = suffixtree.train(docs.where("false"))
    assert all(r["train_tokens"] == 0 and math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in suffixtree.score(docs, blank, none).collect())


def test_tree_of_a_bounded_size(spark, monkeypatch):
    """The most frequent words and followers, whole counts at a time; what is left out still counts for the base."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 50), "", "") for i in range(80)], DOCS)
    whole, counts = suffixtree.train(docs)
    monkeypatch.setattr(suffixtree, "MOST_WORDS", 50)
    monkeypatch.setattr(suffixtree, "MOST", 20)
    small, again = suffixtree.train(docs)
    assert 0 < len(small.words) <= 50 < len(whole.words) and all(len(x["entry"]) <= 20 for x in small.levels)
    assert small.counts.min() > np.sort(whole.counts)[-51]
    a, b = ({r["doc_id"]: r["base_score"] for r in suffixtree.score(docs, *m).collect()} for m in ((whole, counts), (small, again)))
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)



def test_followers_too_many_to_list(spark, monkeypatch):
    """Scores do not depend on what is listed: at any depth, dealt out to one part or to several."""
    rng = random.Random(8)
    prose_ = [" ".join(rng.choice(["a b c d", "e b c f", "a b", "g", "h i c", "e e"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(prose_)] + [(500, None, "", ""), (None, "a b c unseen d", "", "")], DOCS)
    learnt = docs.where("doc_id < 120")
    for depth in (1, 3):
        whole, counts = suffixtree.train(learnt, depth=depth)
        want = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in suffixtree.score(docs, whole, counts).collect())
        sizes = [len(x["entry"]) for x in whole.levels]
        assert whole.rest is None and len(sizes) == depth and all(sizes) and any(r[3] != r[4] for r in want)
        for most, part in ((1, 1 << 30), (1, 300), (30, 300)):
            with monkeypatch.context() as m:
                m.setattr(suffixtree, "MOST", most)
                m.setattr(suffixtree, "PART", part)
                some, again = suffixtree.train(learnt, depth=depth)
                got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in suffixtree.score(docs, some, again).collect())
            assert got == want and (some.rest is not None or most > 1)


def test_learnt_texts_dealt_out_once(spark, monkeypatch):
    """Scores do not depend on whether learnt texts are dealt out for both uses at once, nor on the blocks they are in."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a b c d", "e b c f", "a b", "g", "h i c", "e e"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)] + [(500, None, "", ""), (500, None, "", ""), (None, "a b c unseen d", "", "")], DOCS).repartition(3, "text")
    own = docs["doc_id"] % 3 < 2
    whole, counts = suffixtree.train(docs.where(own))
    rows = lambda *m, **k: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in suffixtree.score(docs, *m, **k).collect())
    want = rows(whole, counts)
    monkeypatch.setattr(suffixtree, "MOST", 1)
    monkeypatch.setattr(suffixtree, "PART", 300)
    for deal, asked in ((1, 1), (400, 100), (1_000_000, 1_000_000)):
        monkeypatch.setattr(suffixtree, "DEAL", deal)
        monkeypatch.setattr(suffixtree, "ASKED", asked)
        some, again = suffixtree.train(docs.where(own))
        assert some.rest is not None and len(some.split) > 1 and rows(some, again, learnt=own) == want and rows(some, again) == want


def test_what_is_dealt_out_is_small(spark, monkeypatch):
    """The bytes shuffled for a tree too large to be listed, a token."""
    rng = np.random.default_rng(10)
    words = (rng.zipf(1.3, size=(2000, 300)) % 20_000).tolist()
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in w), "", "") for i, w in enumerate(words)], DOCS).repartition(2, "doc_id")
    docs = staged(docs, "docs")
    monkeypatch.setattr(suffixtree, "MOST", 1)
    monkeypatch.setattr(suffixtree, "PART", 200_000)

    def written() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    before = written()
    tree, counts = suffixtree.train(docs.where("doc_id % 5 > 0"))
    suffixtree.score(docs, tree, counts, learnt=docs["doc_id"] % 5 > 0).collect()
    per_token = (written() - before) / (2000 * 301)
    assert tree.rest is not None and per_token < 10
def test_states_are_distributions(spark):
    """What a state gives all known words and one unknown word sums to one."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.choice([1, 1, 1, 2, 3, 4])} x{rng.randrange(3)}" for _ in range(40)), "", "") for i in range(100)], DOCS)
    tree, _ = suffixtree.train(docs)
    n = len(tree.words)
    for before in range(n):
        x = np.concatenate([[before, k] for k in [*range(n), -1]])
        root, more = tree.log10(x, np.arange(0, len(x) + 1, 2))
        p = 10 ** (root + more)[1::2]
        p[-1] *= 0.5 / tree.scale
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_packing_plan():
    rng = random.Random(5)
    for cap, sizes in ((10, [rng.randrange(1, 11) for _ in range(200)]), (100, [rng.randrange(1, 101) for _ in range(500)]), (50, [25] * 7 + [26] * 3 + [50] * 2), (12, [7, 7, 5, 5, 6, 6, 4]), (10, [])):
        seqs = packing.plan(Counter(sizes), cap)
        assert Counter(s for times, what in seqs for s, k in what for _ in range(times * k)) == Counter(sizes)
        assert all(sum(s * k for s, k in what) <= cap for _, what in seqs)
        assert sum(times for times, _ in seqs) <= math.ceil(sum(sizes) / cap) * 1.25 + 3
    assert sum(t for t, _ in packing.plan({7: 2, 5: 2, 6: 2, 4: 1}, 12)) == 4


def test_reduction_keeps_the_optimum():
    """What dominance fixes is part of some optimal packing, by exhaustive search."""
    from functools import cache

    rng = random.Random(15)
    for _ in range(120):
        cap = rng.choice([9, 12, 20, 31])
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))]

        @cache
        def optimum(left: tuple, cap=cap) -> int:
            if not left:
                return 0
            big, rest = left[0], left[1:]
            best = 1 + optimum(rest)
            for k in range(1, 1 << len(rest)):
                own = [j for j in range(len(rest)) if k >> j & 1]
                if big + sum(rest[j] for j in own) <= cap:
                    best = min(best, 1 + optimum(tuple(x for j, x in enumerate(rest) if j not in own)))
            return best

        n = [sizes.count(k) for k in range(cap + 1)]
        fixed = packing._dominate(n, cap)
        left = tuple(sorted((k for k in range(cap + 1) for _ in range(n[k])), reverse=True))
        assert sum(t for t, _ in fixed) + optimum(left) == optimum(tuple(sorted(sizes, reverse=True)))
        assert optimum(tuple(sorted(sizes, reverse=True))) <= sum(t for t, _ in packing.plan(Counter(sizes), cap)) <= optimum(tuple(sorted(sizes, reverse=True))) + 1


def test_token_ids_of_every_code_point():
    enc = packing.Encoder(None)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}x" for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 97)]]
    rng = random.Random(14)
    some = [chr(c) for c in range(256)] + [*"Σσςİıß日本é\u0301"] + [" "] * 40 + ["the", "It's", "<|endoftext|>"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(8000)]
    assert enc.by_chunk and enc.encode(texts) == enc._slow(texts)


def test_packing(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(40)] + [prose(rng, 3000), "", None, "It's Ünïcode ΣΑΣ <|endoftext|> x\x1fy 日本語 é", "It's"]
    rows = [(k, t, "s", "t") for k, t in enumerate(texts)] + [(None, "a b", "", ""), (3, texts[3], "", "")]
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), capacity=128).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((i, k, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 128 and len(by) <= math.ceil(sum(by.values()) / 128) + 2
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS)).count() == 0


FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_personal_data(spark):
    card = "4111 1111 1111 1111"
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = f"é a.b@c.example.org, 10.0.0.256 10.0.0.1 {card} +1 (555) 123-4567 x@y.z@w.v @q"
    rows = [(k, f"call id: {k}0.1.2.3 now" if k < 24 else f"call id: Q-{k}-77 now", "", "") for k in range(26)] + [(120, text, "", ""), (121, None, "", ""), (121, "", "", ""), (None, "call id: ZZ_9", "", "")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    for i, t, *_ in rows:
        want = sorted((m.start(), n, m.end()) for n, (kind, p) in enumerate(FORMS.items()) for m in p.finditer(t or "") if ok(kind, m.group()))
        assert [tuple(s) for s in got[i]["base"]] == want
    assert [(t, s["kind"]) for k in (24, 25) for s in got[k]["more"] for t in [rows[k][1][s["start"] : s["end"]]]] == [("Q-24-77", "ip"), ("Q-25-77", "ip")]
    assert pii.personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_personal_data_spreads_to_new_patterns(spark):
    """No fixed form follows "badge no.:"; its badges stand after "call id:" too, which many addresses follow."""
    texts = [f"call id: 10.1.2.{k} now" for k in range(80)]
    texts += [f"call id: X{k}-22 now" for k in range(12)] + [f"badge no.: X{k}-22 now" for k in range(13)] + ["of type: Y1-22 now"] * 30
    got = {r["doc_id"]: r["more"] for r in pii.personal_data(spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], DOCS)).collect()}
    found = {t[s["start"] : s["end"]]: s["kind"] for k, t in enumerate(texts) for s in got[k] if t.startswith("badge")}
    assert found.get("X12-22") == "ip" and len(found) == 13 and not any(got[k] for k in range(105, len(texts)))


def test_candidates_across_spaces_and_of_any_length():
    long = "k9" * 400
    t = f"tax id: 123 456 789, key {long}; 12345 10.0.0.1 and 12 3456x 2024"
    found = [t[a:b] for a, b, seed in pii.candidates(t, pii.base_spans(t)) if seed is None]
    assert found == ["123 456 789", long, "12345", "12", "3456x", "2024"]


def test_ips_like_the_expression():
    rng = random.Random(18)
    for _ in range(3000):
        t = "".join(rng.choice("12.. a") for _ in range(rng.randrange(25)))
        assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in FORMS["ip"].finditer(t)], t


@pytest.mark.parametrize("t", ["a" * 10_000_000, "日" * 3_000_000 + "1", "7" * 10_000_000, "a1" * 5_000_000, "1 " * 500_000 + "1" * 5_000_000 + "x", "+1" + "(" * 10_000_000, "x@" + "y" * 10_000_000, "_" * 10_000_000])
def test_long_runs_take_linear_time(t):
    import time

    began = time.process_time()
    pii.candidates(t, pii.base_spans(t))
    assert time.process_time() - began < 4  # a quadratic scan takes hours


def test_occurrences(spark):
    rng = random.Random(19)
    texts = [" ".join(rng.choice(["id", "No.", "x1", "é"]) for _ in range(rng.randrange(9))) for _ in range(60)] + ["", None, "id"]
    src = spark.createDataFrame([(t or "",) for t in texts], "__text string")
    import pyarrow as pa

    keys, want = {}, Counter()
    for t in texts:
        w = (t or "").lower().replace("x1", "x0").split()
        for i in range(len(w) - 1):
            want[(w[i],)] += 1
            if i:
                want[(w[i - 1], w[i])] += 1
    for k in want:
        c = pii._Contexts(pa.array([" ".join([*k, "end"])]))
        keys[int((c.one[0] if len(k) == 1 else c.two[1]).view(np.int64))] = k
    got = {keys[r["pattern"]]: r["total"] for r in pii.occurrences(src, spark.createDataFrame([(k,) for k in keys], "pattern long")).collect()}
    assert got == want


def test_hidden_seeds_are_found_again(spark):
    """Some three of sixteen secrets of the given tables, no longer known as such, come back by their context, and
    little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known, hidden = pii._HEX, re.compile(pii._HEX.pattern.replace("[0-9a-f]{32,}", "[3-9a-f][0-9a-f]{31,}"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lost = {(i, m.start(), m.end()) for i, t in texts.items() for m in known.finditer(t)} - {(i, m.start(), m.end()) for i, t in texts.items() for m in hidden.finditer(t)}
    rows = [(i, t) for i, t in texts.items()]
    # the scan runs in workers: a text whose secret is to be hidden has its first digit marked instead
    marked = []
    for i, t in rows:
        for _, a, b in sorted((x for x in lost if x[0] == i), reverse=True):
            t = t[:a] + "z" + t[a + 1 :]
        marked.append((i, t))
    out = pii.personal_data(spark.createDataFrame(marked, "doc_id long, text string")).collect()
    new = {(r["doc_id"], s["start"], s["end"]) for r in out for s in r["more"]}
    seeds = {(i, m.start(), m.end()) for i, t in marked for m in known.finditer(t)}
    found = new - seeds
    recall, precision = len(found & lost) / len(lost), len(found & lost) / max(1, len(found))
    print("hidden", len(lost), "recall", recall, "precision", precision)
    assert len(lost) > 15 and recall >= 0.9 and precision >= 0.9


def test_emails_like_the_expression():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ 1é") for _ in range(rng.randrange(25)))
        assert pii._emails(t) == [m.span() for m in FORMS["email"].finditer(t)], t


def test_urls(spark):
    rules = Q.URL_RULES
    rows = [(1, "HTTP://A.Example.ORG:80/es/1?x#y", None, "r"), (2, "https://example.org/en/12", "", "r"), (3, "https://example.org/en/2", "", "r"), (4, "https://notexample.org/es/", "", "r"), (5, "x.com/fr/", "", "r"), (6, None, "", "r"), (7, "http://b.com/fr/?q", "", "r"), (8, "http://org", "", "r"), (9, "http://q.net/1", '<a href="http://spam.com/de/1">', "r"), (10, "http://spam.com/de/1", "", "r"), (11, "http://good.net/", "", "r"), (12, "http://b.com/x", '<a href="//GOOD.net/z">', "r"), (9, "http://q.net/1", '<a href="http://spam.com/de/1">', "r")]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), rules).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(rows) and got[1] == ("a.example.org:80", "/es/1", None, "allow")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("org/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("b.com", "/fr/", "com/fr/", "allow") and got[8] == ("org", "", None, "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == ("com/de/", "block") and got[11][2:] == (None, "allow") and got[12][2:] == (None, "allow")
    trust = {r["page_id"]: r["trust"] for r in out}
    assert trust[11] > 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(empty, rules).count() == 0


def test_parent_domains(spark):
    hosts = {"www.a.x.com:80": ["www.a.x.com:80", "a.x.com", "x.com"], "x.com": ["x.com"], "m.x.co.uk": ["m.x.co.uk", "x.co.uk"], "x.co.uk": ["x.co.uk"], "10.0.0.1": ["10.0.0.1"], "localhost": ["localhost"], "a.b.de": ["a.b.de"], "a.longer.de": ["a.longer.de", "longer.de"]}
    got = {r[0]: r[1] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urlfilter.parent_domains(F.col("h"))).collect()}
    assert got == hosts


def test_hosts_of_one_owner_meet(spark):
    """No page is on the parent domain, and the second host has no rule page of its own."""
    rows = [(1, "http://www.bad.net/de/1", '<a href="/de/2">'), (2, "http://m.bad.net/x", '<a href=/y>'), (3, "http://m.good.net/x", ""), (4, "http://www.good.net/fr/1", ""), (5, "http://other.info/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in urlfilter.judge(pages, [("net", "/fr/", "allow"), ("net", "/de/", "block")]).collect()}
    assert [out[k]["verdict"] for k in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert out[2]["rule"] is None and out[2]["distrust"] > 0 and out[3]["trust"] > 0 and out[5]["trust"] == out[5]["distrust"] == 0
    links = {(r["source"], r["target"]): r["weight"] for r in urlfilter.host_links(pages, "url", "html").collect()}
    assert links[("www.bad.net", "www.bad.net")] == 1 and links[("m.bad.net", "bad.net")] == links[("bad.net", "m.bad.net")] == 1


def test_ranks_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "CHANGE", 1e-7)
    rng = random.Random(9)
    edges = {(f"h{rng.randrange(8)}", f"h{rng.randrange(8)}"): float(rng.randrange(1, 4)) for _ in range(25)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    seeds = [("h0", 3.0, 0.0), ("h1", 0.0, 2.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.propagate(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source string, target string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for kind in (0, 1):
        m = np.zeros((8, 8))
        for (a, b), w in edges.items():
            i, j = (int(a[1]), int(b[1])) if kind == 0 else (int(b[1]), int(a[1]))
            m[i, j] += w
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        s = np.zeros(8)
        s[kind] = seeds[kind][1 + kind]
        x = s
        for _ in range(300):
            x = urlfilter.DAMPING * x @ m + (1 - urlfilter.DAMPING) * s
        for k in range(8):
            assert math.isclose(got.get(f"h{k}", (0, 0))[kind], x[k], abs_tol=1e-5)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, name):
    out = Q.QUERIES[name](spark, SF)
    n = out.count()
    table = "pages" if name.startswith("op10") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n == rows if not name.startswith("op4") else n >= rows


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"  # the smallest tables have 18 toxic labels, too few to learn from

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    for d in seen[:-1]:
        assert d.columns == docs.columns
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] and counts[5] >= counts[4]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in seen[1].collect()}
    gone = {r["doc_id"] for r in docs.collect()} - left
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & gone) >= 0.6 * len(toxic) and len(clean & gone) <= 0.02 * len(clean)  # held-out figures: test_toxicity_on_held_out_labels
    assert seen[4].where(F.col("n_chars") != F.length("text")).count() == 0
    assert {r["doc_id"] for r in seen[5].collect()} == {r["doc_id"] for r in seen[4].collect()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, columns of clashing names, and a table without rows."""
    import corpus_pipeline as P

    sf = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    first = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first()
    text = " ".join(f"word{k} of line{k}." for k in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (5, "Before. " + text), (6, text), (6, text), (None, text), (None, None), (7, first["text"]), (8, "x" * 200_000)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, runs_deleted string, id int")
    docs = odd
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i for i, _ in left} >= {1, 2, 3, 4, 8, None} and 6 not in {i for i, _ in left} and dict(x for x in left if x[0] == 4)[4] == text
    assert all(t == "Before. " for i, t in left if i == 5) and docs.where("runs_deleted <> 'mine' OR id <> 3").count() == 0
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = odd.where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
