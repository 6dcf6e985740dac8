"""Each query over the smallest tables, with odd rows among them, against brute force on its contract columns."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import packing, pii, quality, simhash, suffixtree, toxicity, urlfilter
from panelforge.llm import queries as Q

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_components, brute_runs  # noqa: E402
from test_models import FORMS  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with a null, an empty, a blank, a long and an odd text, a repeated row, and a page without url."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()["text"]
    odd = [(10_001, None), (10_002, ""), (10_003, " \n "), (10_004, "long text of 4111 1111 1111 1111 " * 40_000), (10_005, "a\x07b \x1c ok\x00 é 日本 x@y.zz +1 (234) 567-8901 10.0.0.1"), (10_006, first), (10_006, first), (10_007, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of 10.0.0.2')]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[more[c].cast(t) for c, t in docs.dtypes])).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    some = spark.createDataFrame([(90_001, None, None), (90_002, "no host", ""), (90_003, "HTTP://Sub.Example.ORG:80/es/1?q#f", "<a href='//a.example.org/x'>")], "page_id long, url string, html string")
    pages.unionByName(some).unionByName(some).write.parquet(f"{out}/pages.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, tables):
    """(doc_id, text) of every row, by id."""
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None) + [(10_001, None)]


def rows_of(spark, tables, name):
    return Q.QUERIES[name](spark, tables).collect()


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, tables, texts):
    got = rows_of(spark, tables, "op1_line_dedup")
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    own, due = brute_runs([(i, t) for i, t in dict(texts).items() if t])
    before, size = dict(texts), lambda i, ks: sum(len(own[i][k].split()) for k in ks)
    wanted = missed = 0
    for r in got:
        i = r["doc_id"]
        if not before[i] or not due[i]:
            assert r["text"] == before[i] or r["n_deleted"]
            continue
        left = Counter(own[i]) - Counter(x.strip(" \n\r\t") for x in re.split(__import__("panelforge.llm.linededup", fromlist=["_LINES"])._LINES, r["text"] or ""))
        wanted += size(i, due[i])
        missed += size(i, [k for k in due[i] if own[i][k] not in left])
    assert wanted > 1000 and missed <= 0.1 * wanted
    assert all((r["n_deleted"] == 0) == (r["text"] == before[r["doc_id"]]) for r in got)


def test_op2(spark, tables, texts):
    got = rows_of(spark, tables, "op2_toxicity")
    model = toxicity.fit(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    want = Counter()
    for i, t in texts:
        s = sum(model.weights[model.index[f]] for f in toxicity.features(t or "") if f in model.index)
        p = [1 / (1 + math.exp(-(c - s))) for c in model.cuts]
        severity = sum(k * (b - a) for k, (a, b) in enumerate(zip([0, *p], [*p, 1], strict=True)))
        want[(i, round(severity, 6), round(1 - p[0], 6), p[0] <= 0.5)] += 1
    assert model.index and Counter((r["doc_id"], round(r["severity"], 6), round(r["toxic_probability"], 6), r["toxic"]) for r in got) == want


def test_op3(spark, tables, texts):
    got = rows_of(spark, tables, "op3_document_fingerprints")
    order = sorted((i, t or "") for i, t in texts)
    fps = [int(simhash.fingerprints([t])[0]) for _, t in order]
    first = {}
    for (i, _), f in zip(order, fps, strict=True):
        first.setdefault(f, i)
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        e = int(simhash.fingerprints([new])[0])
        like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        near = [g for g in fps if bin(g ^ fps[k]).count("1") <= 3]
        asked = (len(near) - 1, tuple(sorted({first[g] for g in near}))) if i % 50 == 0 else (None, None)
        want[(i, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{fps[k]:016x}", f"{e:016x}", like(fps[k], e), like(fps[k], fps[(k + 1) % len(order)]), first[fps[k]], *asked)] += 1
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "n_within")
    assert Counter((*[r[n] for n in names], None if r["near_class_ids"] is None else tuple(r["near_class_ids"])) for r in got) == want


def test_op4(spark, tables, texts):
    got = rows_of(spark, tables, "op4_best_fit_packing")
    enc, want = packing.Encoder(None), Counter()
    for i, t in texts:
        ids = np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    sizes = Counter(n for _, _, _, n, _ in want.elements())
    least = max(-(-sum(n * c for n, c in sizes.items()) // 2048), sum(c for n, c in sizes.items() if n > 1024))
    assert max(by.values()) <= 2048 and len(by) <= least + 2


def test_op5(spark, tables, texts):
    got = rows_of(spark, tables, "op5_quality_classifier")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    learnt = [r["doc_id"] for r in labels.collect() if crc(r["doc_id"]) % 4 != 2]
    model = quality.fit(spark.read.parquet(f"{tables}/documents.parquet"), labels.where(labels["doc_id"].isin(learnt)))
    want = Counter()
    for i, t in texts:
        q = float(model.quality(pa.array([t or ""]))[0])
        want[(i, crc(i) % 4 == 2, round(q, 5), int(q >= 0.7))] += 1
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 5), r["predicted"]) for r in got) == want


def test_op6(spark, tables, texts):
    got = rows_of(spark, tables, "op6_minhash_near_dedup")
    comp = brute_components([(i, t) for i, t in texts], 3, 85, 100)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((i, *comp[i], comp[i][1] == i) for i, _ in texts)


def test_op7(spark, tables, texts):
    got = rows_of(spark, tables, "op7_lm_scoring")
    tokens = lambda t: [*WORD.findall((t or "").encode().lower()), None]
    c = Counter(x for i, t in texts if crc(i) % 5 != 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in texts:
        w = tokens(t)
        want[(i, crc(i) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) / len(w), 7))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"] / r["n_tokens"], 7)) for r in got) == want
    # the score by a walk over the tree's states, one token after the other
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    tree, _ = suffixtree.train(docs.where(docs["doc_id"].isin([i for i, _ in texts if crc(i) % 5 != 1])))
    own = {r["doc_id"]: r for r in got}
    held_base = held_score = 0.0
    for i, t in texts[:60]:
        x, offs = suffixtree._tokens(pa.array([t or ""]))
        total = slow_score(tree, x)
        assert math.isclose(total, own[i]["score"], rel_tol=1e-6, abs_tol=1e-6)
        if own[i]["held_out"]:
            held_base, held_score = held_base + own[i]["base_score"], held_score + own[i]["score"]
    assert held_score >= held_base


def test_op8(spark, tables, texts):
    got = rows_of(spark, tables, "op8_benchmark_decontamination")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        w = word.findall((r["text"] or "").encode().lower())
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(r["item_id"]))
    sizes, want = {len(k) for k in windows}, Counter()
    for i, t in texts:
        w = word.findall((t or "").encode().lower())
        hit, items = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    items |= own
        want[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert sum(x[5] for x in want) >= 3


def test_op9(spark, tables, texts):
    got = rows_of(spark, tables, "op9_pii")

    def right(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        return {"email": True, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    want, more = Counter(), 0
    text = dict(texts)
    for i, t in texts:
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(FORMS.items()) for m in p.finditer(t or "") if right(kind, m.group()))
        counts = Counter(s[2] for s in spans)
        want[(i, *[counts[k] for k in FORMS], hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert r["n_spans"] == len(spans) and [a for _, a, _ in spans] == sorted(a for _, a, _ in spans)
        base = [s for s in spans if s[0] in FORMS]
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() == r["base_sha256"] or len(base) > sum(r[f"n_{k}"] for k in FORMS)
        secrets = [(m.start(), m.end()) for m in pii._HEX.finditer(text[r["doc_id"]] or "")]
        assert set(secrets) <= {(a, b) for k, a, b in spans if k == pii.SECRET}
        more += len(secrets)
    assert more > 0


def test_op10(spark, tables):
    pages = [tuple(r) for r in spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "url", "html").collect()]
    got = Q.QUERIES["op10_url_filters"](spark, tables).collect()

    def split(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        return (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h) + len(p), h + p, v) for h, p, v in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    links, seeds = Counter(), defaultdict(lambda: [0.0, 0.0])
    hosts = set()
    for _, url, html in pages:
        host, path = split(url)
        if not host:
            continue
        hosts.add(host)
        v = rule(host, path)[1]
        if v:
            seeds[host][v == "block"] += 1
        for u in re.findall(r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", html or ""):
            to = split("x:" + u)[0] if u.startswith("//") else split(u)[0] if re.match(r"(?i)[a-z][a-z0-9+.-]*://", u) else None if re.match(r"(?i)[a-z][a-z0-9+.-]*:", u) else host
            if to:
                links[(host, to)] += 1
                hosts.add(to)
    pairs = set()
    for h in hosts:
        name = re.sub(r":\d*$", "", h).split(".")
        least = 3 if len(name) > 1 and len(name[-2]) <= 3 and re.fullmatch("[a-z]{2}", name[-1]) else 2
        chain = [h, *[".".join(name[k:]) for k in range(1, len(name) - least + 1)]]
        pairs |= set(zip(chain[:-1], chain[1:], strict=True))
    for a, b in pairs:
        links[(a, b)] += 1
        links[(b, a)] += 1
    names = sorted({x for e in links for x in e} | set(seeds))
    at = {h: k for k, h in enumerate(names)}
    ranks = []
    for kind in (0, 1):
        m = np.zeros((len(names), len(names)))
        for (a, b), w in links.items():
            m[(at[a], at[b]) if kind == 0 else (at[b], at[a])] += w
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        s = np.array([seeds[h][kind] if h in seeds else 0.0 for h in names])
        x = s
        for _ in range(400):
            x = urlfilter.DAMPING * x @ m + (1 - urlfilter.DAMPING) * s
        ranks.append(x)
    want, near = Counter(), 0
    for i, url, _ in pages:
        host, path = split(url)
        name, verdict = rule(host, path)
        t, d = (ranks[0][at[host]], ranks[1][at[host]]) if host in at else (0.0, 0.0)
        near += verdict is None and 0.45 < d / max(t + d, 1e-12) < 0.55
        want[(i, host, path, name, verdict or ("block" if d > 0.5 * (t + d) else "allow"))] += 1
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got)
    assert sum((found - want).values()) <= near and sum(found.values()) == len(pages)


def slow_score(tree, x):
    """log10 of the probability of one text's tokens, by dictionaries."""
    number = {int(h): k for k, h in enumerate(tree.words)}
    w = [number.get(int(h), -1) for h in x]
    total = 0.0
    states = [{int(s): k for k, s in enumerate(level["state"])} for level in tree.levels]
    listed = [{int(e): c for e, c in zip(level["entry"], level["count"], strict=True)} for level in tree.levels]
    for k, (h, a) in enumerate(zip(x, w, strict=True)):
        p = (tree.counts[a] + 0.5) / tree.scale if a >= 0 else (train_counts.get(int(h), 0) + 0.5) / tree.scale
        start = len(tree.words)
        context = [w[j] if j >= 0 else start for j in range(k - 1, k - 1 - len(tree.levels), -1)]
        for depth, level in enumerate(tree.levels, 1):
            own = context[:depth]
            if any(c < 0 for c in own) or start in own[:-1]:
                break
            key = 0
            for c in reversed(own):
                key = key << int(suffixtree._SHIFT) | c
            s = states[depth - 1].get(key)
            if s is None:
                break
            c = listed[depth - 1].get(s << int(suffixtree._SHIFT) | a, 0) if a >= 0 else 0
            p = c / (level["total"][s] + suffixtree.MU) + level["share"][s] * p
        total += math.log10(p)
    return total


train_counts: dict[int, int] = {}


@pytest.fixture(autouse=True)
def words_of_training(texts):
    """Counts of all training words by hash, for slow_score(): the tree lists frequent ones only."""
    if not train_counts:
        for i, t in texts:
            if crc(i) % 5 != 1:
                for h in suffixtree._tokens(pa.array([t or ""]))[0]:
                    train_counts[int(h)] = train_counts.get(int(h), 0) + 1
    yield
