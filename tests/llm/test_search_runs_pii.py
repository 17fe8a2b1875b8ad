"""Ranked search, periodic runs and personal data against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_inputs import SF_SMALL, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from flowlens.llm import periodic, pii, search

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sf(spark, table):
    return spark.read.parquet(f"{SF_SMALL}/{table}.parquet")


# ranked search

def ranking(docs, items, top=50):
    counted = [(d, Counter(search.terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(search.terms(text)) if t in c)
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        for rank, (score, d) in enumerate(sorted(scored)[:top], 1):
            out[item, rank] = (None if d == math.inf else d, -score)
    return out


def found(df):
    rows = df.collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_search_on_the_documents(spark):
    docs, items = sf(spark, "documents").select("doc_id", "text"), sf(spark, "benchmark").select("item_id", "text")
    assert found(search.op11_max_sketches(docs, items)) == ranking([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


@pytest.mark.parametrize("coordinates,block,seed", [(1 << 16, 200_000, 64), (8, 30, 3)])
def test_search_ties_copies_and_collisions(spark, monkeypatch, coordinates, block, seed):
    monkeypatch.setattr(search, "COORDINATES", coordinates)
    monkeypatch.setattr(search, "CELLS", 40)
    r = random.Random(5)
    pool = prose(4, 40).split()
    docs = [(i, " ".join(r.choices(pool, k=r.randint(1, 30)))) for i in range(150)]
    docs += [(500 - i, docs[0][1]) for i in range(80)] + [(3, "again " + docs[0][1]), (None, docs[0][1]), (None, None), (900, "")]
    items = [(i, " ".join(r.sample(pool, 6))) for i in range(12)] + [(50, None), (51, "never seen words"), (52, docs[0][1].upper())]
    got = search.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"),
                        block_pairs=block, seed_share=seed)
    assert found(got) == ranking(docs, items)


def test_search_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "one TWO"), (1, "same"), (None, "same x"), (2, "")], "item_id long, text string")
    want = ranking([(r.doc_id, r.text) for r in odd_docs.collect()], [(1, "one two same"), (None, "same x")])
    assert found(search.op11_max_sketches(odd_docs, items)) == want
    assert search.op11_max_sketches(odd_docs.limit(0), items).collect() == []
    assert search.op11_max_sketches(odd_docs, items.limit(0)).collect() == []
    assert search.op11_max_sketches(odd_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


# periodic runs

def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_match_brute_force(letters):
    r = random.Random(letters)
    sequences = []
    for _ in range(150):
        w = [r.randrange(letters) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            unit = [r.randrange(letters) for _ in range(r.randint(1, 9))]
            at = r.randint(0, len(w))
            w[at:at] = (unit * 9)[:r.randint(1, 9 * len(unit))]
        sequences.append(np.array(w, np.int64))
    owner, start, length, period = periodic.runs(sequences)
    got = [[] for _ in sequences]
    for row in zip(owner, start, length, period, strict=True):
        got[row[0]].append(tuple(int(x) for x in row[1:]))
    assert got == [brute_runs(list(s)) for s in sequences]


def test_smaller_looks_back_over_long_chains():
    values = np.array([0, *range(1, 3000), 5, 3000, 2, 7, 0, 4])
    at = np.flatnonzero(values)
    want = [max(j for j in range(i) if values[j] < values[i]) for i in at]
    assert periodic.smaller(values, at).tolist() == want


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and w and h % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(kept))


def test_runs_on_documents(spark):
    docs = [(r.doc_id, " ".join(WORD.findall(r.text)[:250])) for r in sf(spark, "documents").collect()]
    docs += [(1000 + i, " ".join(["a", "b", "c"][:1 + i % 3] * 20) + " " + prose(i, 9)) for i in range(30)]
    got = [tuple(r) for r in periodic.op12_branching_tandems(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got) == sorted(runs_row(*d) for d in docs)
    assert any(r[1] > 1 for r in got)


def test_runs_of_a_very_long_text():
    unit = np.arange(500)
    _, start, length, period = periodic.runs([np.concatenate([np.arange(1000, 1100), np.tile(unit, 400), [7]]), np.zeros(200_000, np.int64)])
    assert [x.tolist() for x in (start, length, period)] == [[100, 0], [200_000, 200_000], [500, 1]]


def test_runs_odd_rows(odd_docs):
    rows = periodic.op12_branching_tandems(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    none = next(r for r in rows if r.doc_id == 1)
    assert tuple(none) == (1, 0, None, None, None, None, digest(""), digest(""))
    assert len({tuple(r) for r in rows if r.doc_id == 4}) == 1
    assert periodic.op12_branching_tandems(odd_docs.limit(0)).collect() == []


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [int(d) * 2 for d in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in double)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if sound(k, m[0])]


def test_base_spans_on_documents(spark):
    r = random.Random(8)
    docs = [(d.doc_id, d.text) for d in sf(spark, "documents").collect()]
    docs += [(10_000 + i, "".join(r.choices("a1.@+- (5", [3, 5, 4, 2, 1, 1, 1, 1, 4], k=80))) for i in range(600)]
    docs += [(20_000, "4111 1111 1111 1111, 4111-1111-1111-1112"), (20_001, "1.2.3.4.5.6.7.8 1.2.3.256"), (20_002, None)]
    rows = {r.doc_id: r for r in pii.op13_deobfuscation(spark.createDataFrame(docs, DOCS)).collect()}
    for d, text in docs:
        want = base_spans(text)
        listed = [":".join(map(str, s)) for s in want]
        assert rows[d].base_sha256 == digest(",".join(listed))
        assert [rows[d][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert set(listed) - {""} <= set(rows[d].spans.split(","))
        if d < 10_000:
            assert rows[d].n_added == 0


@pytest.mark.parametrize("kind,hidden", [
    ("email", "die.55 (at) mail4 (dot) example (dot) com"), ("email", "die.55[at]mail4[dot]example[dot]com"),
    ("email", "die.55 at mail4 dot example dot com"), ("email", "john dot smith at example dot org"), ("email", "john AT example.com"),
    ("email", "jo​hn@exa​mple.com"), ("email", "jоhn.55@mаil4.example.com"), ("email", "die.55＠mail4.example.com"),
    ("email", "die.55 @ mail4.example.com"), ("email", "die.55&#64;mail4&#46;example&#46;com"), ("email", "die.55@mail4 dot example dot com"),
    ("ip", "129[.]38[.]82[.]176"), ("ip", "129 dot 38 dot 82 dot 176"), ("ip", "one two nine dot three eight dot eight two dot one seven six"),
    ("ip", "１２９.38.82.176"), ("ip", "129․38․82․176"),
    ("card", "four one one one " + "one " * 11 + "one"), ("card", "４111 1111 1111 1111"), ("card", "4111–1111–1111–1111"),
    ("card", "4111 1111 1111 1111"), ("card", "quatre un un un " + "un " * 11 + "un"),
    ("phone", "plus one nine seven four five five five three four three six"), ("phone", "+1 (974) five five five - 3436"),
    ("phone", "＋1 (974) 555‑3436"), ("phone", "+١ (974) 555-3436"), ("phone", "+1 (9‍74) 555-3436"),
])
def test_disguised_spans(kind, hidden):
    text = f"Ndé shat the {hidden}, ering at was."
    base, added = pii.find(text)
    start = text.index(hidden)
    assert (start, start + len(hidden)) in added[pii.KINDS.index(kind)]
    assert [(k, a, b) for k, spans in zip(pii.KINDS, base, strict=True) for a, b in spans] == base_spans(text)


@pytest.mark.parametrize("text", [
    "look at example.com and wait", "she was at home. The dot on the i", "one of two, three or four at a time", "un deux trois quatre",
    "meet at the point in time dot com bubble", "version one point five", "4111 1111 1111 1112", "привет мир",
    "at 10.5 or 11.5 dot 3", "café à la crème (at home) [dot]", "x² + y² = 25 – 30"])
def test_clean_texts_stay_clean(text):
    assert [s for spans in pii.find(text)[1] for s in spans] == []


@pytest.mark.parametrize("piece", ["x", "1", " ", "a@", "1.", "+1", "one ", " dot ", "(at)", "​", "a at b dot ", "1 ", "[ ", "zero dot "])
def test_identifiers_take_linear_time(piece):
    pii.find(piece * 60_000)


def test_personal_data_odd_rows(odd_docs):
    rows = pii.op13_deobfuscation(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.base_sha256, r.spans, r.n_email) for r in rows if r.doc_id in (1, 2, 3, None)} == {(digest(""), "", 0)}
    assert pii.op13_deobfuscation(odd_docs.limit(0)).collect() == []


def test_mask(spark):
    df = spark.createDataFrame([(1, "a die.55 at mail4 dot example dot com b 1.2.3.4 c", 7), (2, None, 8)], "doc_id long, text string, kinds int")
    assert sorted(map(tuple, pii.mask(df).collect())) == [(1, "a <email> b <ip> c", 7), (2, None, 8)]
    assert pii.mask(df).select(F.col("kinds")).count() == 2
