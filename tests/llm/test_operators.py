"""Each operator against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from llm_inputs import SF_SMALL, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from flowlens.llm import (chat, decontam, fmindex, learning, mixing, neardup, quality_model, quality_rules, sharding, substring,
                          token_counts, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def sf(spark, table):
    return spark.read.parquet(f"{SF_SMALL}/{table}.parquet")


# sharding

def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used + 1, s) if at + s > mid else (used, at + s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("near_cuts", [50_000, 3])
def test_sharding_takes_the_least_capacity(spark, near_cuts):
    docs = spark.createDataFrame([(i, prose(i % 180, 5 + i % 37)) for i in range(400)], DOCS)
    rows = sharding.minimax_shards(docs, 7, near_cuts=near_cuts).collect()
    groups = Counter()
    for r in rows:
        groups[r.text_key] += r.size
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) == least_capacity([groups[k] for k in sorted(groups)], 7)
    assert all(len({r.shard for r in rows if r.text_key == k}) == 1 for k in groups)
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_gives_oversize_groups_a_shard(spark):
    docs = spark.createDataFrame([(i, "copy " * 50) for i in range(300)] + [(1000 + i, prose(i, 10)) for i in range(200)], DOCS)
    rows = sharding.minimax_shards(docs, 5).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert len(loads) == 5 and len({r.shard for r in rows if r.doc_id < 1000}) == 1
    rest = sorted(loads.values())[:-1]
    assert max(rest) < 1.1 * min(rest)


def test_sharding_odd_rows(odd_docs):
    rows = sharding.op1_minimax_shards(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.law for r in rows} == {"bytes"}
    null = next(r for r in rows if r.doc_id == 1)
    assert (null["size"], null.text_crc32) == (8, 0)
    assert next(r for r in rows if r.doc_id == 7).text_crc32 == zlib.crc32(b"one two")
    assert sharding.op1_minimax_shards(odd_docs.limit(0)).collect() == []


# near-duplicates

def components(rows, percent):
    sets = {}
    for d, t in rows:
        low = (t or "").translate(neardup.LOWER)
        w = WORD.findall(low)
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


def mutants(seed, n, copies, edits):
    r, base = random.Random(seed), prose(seed, n).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n)] = prose(r.random(), 1)
        yield " ".join(w)


@pytest.mark.parametrize("percent,block", [(85, 1_000), (80, 2)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK", 3 * block)
    texts = [t for s in range(4) for t in mutants(s, 150, 25, 5)] + [prose(99, 60), prose(99, 60).upper(), "a b", "A B", "", None]
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), percent).collect()
    want = components(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


@pytest.mark.parametrize("block", [1_000, 2])
def test_ids_with_several_texts_are_one_document(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK", 3 * block)
    families = [list(mutants(s, 120, 30, 4)) for s in range(4)]
    rows = [(i, families[i % 4][i // 4]) for i in range(60)] + [(i, families[(i // 4) % 2 if i < 40 else i % 4][15 + i // 4]) for i in range(60)]
    rows += [(70, prose(70, 60)), (70, prose(71, 60)), (71, prose(71, 60)), (72, prose(70, 60)), (73, "a b"), (73, ""), (73, None)]
    keyed = {n: row for n, row in enumerate(rows)}
    want = components([(n, t) for n, (_, t) in keyed.items()], 85)
    root = {n: want[n][1] for n in keyed}
    changed = True
    while changed:  # rows of one doc_id are one document
        changed = False
        for group in ([n for n in keyed if keyed[n][0] == d] for d in {d for d, _ in rows}):
            full = [n for n in group if want[n][0]]
            least = min((root[n] for n in full), default=None)
            for n in full:
                for m in [m for m in keyed if root[m] == root[n] != least]:
                    root[m], changed = least, True
    names = {c: min(keyed[n][0] for n in keyed if root[n] == c and want[n][0]) for c in set(root.values()) if any(
        root[n] == c and want[n][0] for n in keyed)}
    expected = Counter((keyed[n][0], want[n][0], names[root[n]] if want[n][0] else keyed[n][0]) for n in keyed)
    runs = []
    for parts in (3, 7):
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts), 85)
        runs.append(Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()))
    assert runs == [expected, expected]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, neardup.keep_one(docs, 85).collect())) == sorted(map(tuple, neardup.keep_one(docs.repartition(5), 85).collect()))


def test_near_duplicates_on_the_documents(spark):
    docs = sf(spark, "documents").select("doc_id", "text")
    want = components([tuple(r) for r in docs.collect()], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op2_odd_sketches(docs).collect()} == want


def test_near_duplicates_odd_rows(odd_docs):
    rows = neardup.op2_odd_sketches(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, True)}
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 5, 6)} == {(1, 1), (2, 2), (3, 3), (5, 5), (6, 5)}
    assert neardup.op2_odd_sketches(odd_docs.limit(0)).collect() == []
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == {None: 2, **dict.fromkeys((1, 2, 3, 4, 5, 7, 8, 9, 10, 11), 1)}


# decontamination

def test_leaks_match_a_text_search(spark):
    docs, bench = sf(spark, "documents"), sf(spark, "benchmark")
    items = [tuple(r) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in d.text}
    assert {(r.doc_id, r.item_id) for r in decontam.op3_simhash_leaks(docs, bench).collect()} == want


@pytest.mark.parametrize("shortest", [5, 9, 15, 40])
def test_leaks_at_every_offset_and_size(spark, shortest):
    items = [(i, prose(i, shortest + 3 * i)) for i in range(6)]
    changed = [(7, " ".join(["odd", *items[0][1].split()[1:]])), (8, items[1][1].upper().replace(" ", ",\n"))]
    docs = [(100 * i + k, prose(1000 + i, k) + " " + t + " " + prose(2000 + i, 40)) for i, t in items for k in range(5)]
    docs += [(-d, prose(5, 9) + " " + t) for d, t in changed] + [(-1, prose(77, 4000)), (-2, None), (None, items[0][1])]
    bench = spark.createDataFrame([*items, (90, "too short"), (91, None), (92, items[5][1])], "item_id long, text string")
    found = decontam.leaks(spark.createDataFrame(docs, DOCS), bench).collect()
    want = {(100 * i + k, i) for i, _ in items for k in range(5)} | {(500 + k, 92) for k in range(5)} | {(-8, 1)}
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got <= want | {(-7, 0)}
    assert all(r.start == max(0, r.doc_id % 100) for r in found if r.doc_id >= 0)


def brute_leaks(docs, items):
    """Pairs where the words in an item's place have a weighted similarity of 0.8: in places that a shared shingle proposes, in any."""
    def shingles(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    proposed, anywhere = set(), set()
    for d, t in docs:
        w = t.split()
        for i, item in items:
            n, own = len(item.split()), shingles(item.split())
            shared = {p - own.index(x) for p, x in enumerate(shingles(w)) if x in own}
            for start in {s + k for s in shared for k in range(1 - n, n)}:
                there, have = Counter(shingles(w[max(0, start):max(0, start + n)])), Counter(own)
                if 10 * (have & there).total() >= 8 * (have | there).total():
                    anywhere.add((d, i))
                    if start in shared:
                        proposed.add((d, i))
    return proposed, anywhere


@pytest.mark.parametrize("shortest", [9, 12, 15, 40])
def test_leaks_with_edited_edges_match_brute_force(spark, shortest):
    items = [(i, prose(i, shortest + i % 3)) for i in range(8)]
    docs = []
    for i, t in items:
        w = t.split()
        half = len(w) // 2
        forms = [["odd", *w[1:]], [*w[:-1], "odd"], w[1:], w[:-1], ["odd", *w[1:-1], "odd"], [*w[:half], "odd", *w[half:]],
                 [*w[:half], *w[half + 1:]], [*w[:half], "odd", *w[half + 1:]], w]
        docs += [" ".join([prose(100 * i + k, k), *f, *prose(50 + i, tail).split()])
                 for f in forms for k in range(4) for tail in (0, 9)] + [" ".join([prose(k, k), *w[:-2]]) for k in range(4)]
    docs = list(enumerate(docs))
    bench = spark.createDataFrame(items, "item_id long, text string")
    proposed, anywhere = brute_leaks(docs, items)
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert proposed <= found <= anywhere


def test_leaks_odd_tables(spark, odd_docs):
    bench = sf(spark, "benchmark")
    assert decontam.op3_simhash_leaks(odd_docs, bench).collect() == []
    assert decontam.op3_simhash_leaks(odd_docs.limit(0), bench).collect() == []
    assert decontam.op3_simhash_leaks(odd_docs, bench.limit(0)).collect() == []


# quality rules

def base(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    covered = {j for i, t in enumerate(three) if n[t] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_base_counts(spark, odd_docs, table):
    docs = odd_docs if table == "odd" else sf(spark, "documents")
    got = quality_rules.op4_weak_supervision(docs).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_em_finds_the_accuracies():
    r, patterns = random.Random(5), Counter()
    true = [(0.8, 0.95), (0.6, 0.9), (0.7, 0.98), (0.9, 0.85)]
    for _ in range(20_000):
        good = r.random() < 0.85
        patterns[tuple(None if r.random() < 0.2 else int((r.random() < a[good]) == good) for a in true)] += 1
    share, acc = quality_rules.fit(list(patterns.items()))
    assert abs(share - 0.85) < 0.05
    assert all(abs(x - y) < 0.1 for a, b in zip(acc, true, strict=True) for x, y in zip(a, b, strict=True))


def test_rules_keep_clean_documents_and_drop_marked_ones(spark):
    docs = sf(spark, "documents").join(sf(spark, "labels"), "doc_id")
    rows = quality_rules.op4_weak_supervision(docs).join(docs.select("doc_id", F.col("quality").alias("q")), "doc_id").collect()
    clean = [r for r in rows if r.q == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert quality_rules.op4_weak_supervision(docs.limit(0)).collect() == []
    assert quality_rules.keep_good(docs).columns == docs.columns


# mixing

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = dict(zip(names, [(3, 1, 2)[i % 3] for i in range(len(names))], strict=True))
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_mix_meets_its_targets(spark, odd_docs, table):
    docs = odd_docs if table == "odd" else sf(spark, "documents")
    rows = mixing.entropy_mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = brute_targets(dict(sizes))
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    if table == "documents":
        assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)
        again = mixing.entropy_mix(docs.repartition(5)).collect()
        assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
        repeated = mixing.repeat_rows(docs)
        assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in rows)
    assert mixing.op5_entropy_mix(docs.limit(0)).collect() == []


# trained models

def test_factorization_machine_learns_pairs():
    """Toxic if exactly one of the two terms is there: no sum of weights can say that."""
    import numpy as np

    r = random.Random(3)

    def sample(n):
        texts, labels = [], []
        for _ in range(n):
            a, b = r.random() < 0.5, r.random() < 0.5
            terms = {r.randrange(100, 4000) for _ in range(20)} | ({1, 2} if a else {3, 4}) | ({5, 6} if b and r.random() < 1 else {7, 8})
            texts.append(np.array(sorted(terms), np.int32))
            labels.append(float(a and b or (a and r.random() < 0.1)))
        return texts, np.array(labels)

    m = toxicity.fit(*sample(3000))
    texts, labels = sample(600)
    p = m.probabilities(texts)
    assert ((p >= 0.5) == labels).mean() > 0.93 and np.abs(m.v).sum() > 0


@pytest.mark.parametrize("others", [20, 60])
def test_factorization_machine_learns_pairs_of_terms_that_say_nothing_alone(others):
    """An exclusive or: each of the four terms is as common in toxic texts as in others."""
    import numpy as np

    r = random.Random(4)

    def sample(n):
        texts, labels = [], []
        for i in range(n):
            a, b = i % 2, i // 2 % 2
            texts.append(np.array(sorted({r.randrange(100, 4000) for _ in range(others)} | {1 + a, 3 + b}), np.int32))
            labels.append(float(a != b))
        return texts, np.array(labels)

    m = toxicity.fit(*sample(3000))
    texts, labels = sample(800)
    assert ((m.probabilities(texts) >= 0.5) == labels).mean() > 0.95


@pytest.mark.parametrize("others,least", [(200, 0.97), (2000, 0.9)])
def test_insults_beside_a_group_in_long_texts(others, least):
    """Toxic if an insult and a group's mention stand in one text; either alone is not."""
    import numpy as np

    r = random.Random(1)

    def sample(n):
        texts, labels = [], []
        for _ in range(n):
            a, b = r.random() < 0.4, r.random() < 0.4
            terms = {int(4000 * r.random() ** 3) + 100 for _ in range(others)} | ({1} if a else set()) | ({2} if b else set())
            texts.append(np.array(sorted(terms), np.int32))
            labels.append(float(a and b))
        return texts, np.array(labels)

    m = toxicity.fit(*sample(3000))
    texts, labels = sample(800)
    with_pairs = ((m.probabilities(texts) >= 0.5) == labels).mean()
    assert with_pairs >= least
    if others == 200:
        m.v[:] = 0
        assert ((m.probabilities(texts) >= 0.5) == labels).mean() < with_pairs - 0.05


def test_pairs_change_scores_of_real_documents():
    import numpy as np
    import pyarrow.parquet as pq

    base = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{base}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{base}/labels.parquet").to_pylist() if r["toxic"] is not None}
    read = toxicity.reader()
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in labels}
    learn, judge = ([read(texts[d]) for d in sorted(labels) if held[d] == h] for h in (False, True))
    y, truth = (np.array([labels[d] for d in sorted(labels) if held[d] == h], float) for h in (False, True))
    m = toxicity.fit(learn, y)
    p = m.probabilities(judge)
    m.v[:] = 0
    assert np.abs(p - m.probabilities(judge)).max() > 0.1
    assert ((p >= 0.7) & (truth == 1)).sum() >= 0.8 * truth.sum() and ((p >= 0.7) & (truth == 0)).sum() <= 3


def docs_and_labels(spark, toxic):
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = prose(i, 40) + (" mudhead " + prose(-i, 3) if bad and toxic else "")
        rows.append((i, ("ZZ!! " * 30 if bad and not toxic else "") + text, int(bad if toxic else not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic" if toxic else "quality"))
    return docs.drop("y"), labels


@pytest.mark.parametrize("toxic", [True, False])
def test_models_tell_held_out_documents(spark, odd_docs, toxic):
    run, folds, out = (toxicity.toxicity, 3, 1) if toxic else (quality_model.quality, 4, 2)
    docs, labels = docs_and_labels(spark, toxic)
    rows = run(docs, labels).collect()
    truth = {r.doc_id: r[1] for r in labels.collect()}
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = run(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert run(docs.limit(0), labels).collect() == []
    assert {r.score for r in run(odd_docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("fetched", [0, 1_500_000])
def test_quality_learns_from_whole_training_texts(spark, monkeypatch, fetched):
    """What tells the labels stands at the 50th to 90th word of 240 only."""
    monkeypatch.setattr(learning, "FETCHED", fetched)
    monkeypatch.setattr(learning, "PARTS", 5)
    rows = [(i, prose(i, 50) + (" ZZ!!" * 40 if i % 4 == 0 else " " + prose(-i, 40)) + " " + prose(i + 0.5, 150), int(i % 4 > 0))
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held_out = [r for r in quality_model.quality(docs.drop("quality"), docs.drop("text")).collect() if r.held_out]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held_out) >= 0.95 * len(held_out)


def test_training_texts_are_read_as_scored_ones():
    import numpy as np

    m = quality_model.Model()
    for text in (prose(1, 700), "a a a b " * 90, "one", "x" * 90 + " y", prose(2, 40_000).replace(" ", "") + " z"):
        rows, weight = quality_model.weighted(quality_model.reader()(text))
        assert np.allclose(weight @ m.rows[rows], quality_model.Vectors(m.rows).document(text.split()), atol=1e-5)


def test_samples_hold_whole_texts_within_their_bound(spark):
    import numpy as np

    rows = [(i, prose(i, 5 + i % 50), i % 2) for i in range(300)] + [(900, None, 1), (5, "", 1), (5, prose(5, 10), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labelled = learning.labelled(docs, docs, "y", lambda c: c >= 0)
    read = lambda: lambda t: np.full(len(t), len(t), np.int32)
    whole = learning.Sample(labelled, read, "test")
    assert len(whole.texts) == len(whole.labels) == 300 and all(len(t) == (t[0] if len(t) else 0) for t in whole.texts)
    few = learning.Sample(labelled, read, "test", most_numbers=9_000)
    assert sum(map(len, few.texts)) <= 9_000 and len(few.texts) > 20
    assert [len(t) for t in few.texts] == [len(t) for t in whole.texts[:len(few.texts)]]


def test_one_long_word_counts_whole():
    """The n-grams of a word's middle change its vector."""
    import numpy as np

    m, word = quality_model.Model(), prose(3, 60).replace(" ", "")
    other = word[:100] + "zzzz" + word[104:]
    vectors = quality_model.Vectors(m.rows)
    assert not np.allclose(vectors.document([word]), vectors.document([other]), atol=1e-4)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = docs_and_labels(spark, True)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    same = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped)]
    assert same[0] == same[1]


# repeated passages

def brute_removed(rows, window):
    first, out = {}, {}
    for d, t in sorted(r for r in rows if r[0] is not None):
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i:i + window])] < d
                for j in range(i, i + window)} if d is not None else set()
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digests(rows, window, docs, hot=substring.HOT_WORDS):
    have, lost = substring.repeated_passages(docs, window, hot_words=hot)
    lost = {(r.r_id, r.r_t): r for r in lost.collect()}
    return {r.doc_id: (r.n_words, lost[r.doc_id, r.t].n_removed, lost[r.doc_id, r.t].r_sha) if (r.doc_id, r.t) in lost
            else (r.n_words, 0, r.sha) for r in have.collect()}


@pytest.mark.parametrize("hot", [substring.HOT_WORDS, 100])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    monkeypatch.setattr(substring, "MOST_WINDOWS", 16)
    shared = [prose(i, 35) for i in range(5)]
    r = random.Random(1)
    rows = [(i, " ".join(prose(100 * i + k, r.randint(1, 30)) + "\n" + r.choice(shared) for k in range(4))) for i in range(40)]
    rows += [(50, "la " * 300), (51, "la " * 90), (52, rows[3][1]), (53, None), (54, ""), (None, rows[3][1])]
    assert digests(rows, 20, spark.createDataFrame(rows, DOCS), hot) == brute_removed(rows, 20)


def test_passages_on_the_documents(spark, odd_docs):
    docs = sf(spark, "documents").select("doc_id", "text")
    want = brute_removed([tuple(r) for r in docs.collect()], 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op8_fm_passages(docs).collect()} == want
    odd = substring.op8_fm_passages(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {(r.doc_id, r.n_removed) for r in odd} >= {(4, 0), (5, 0), (6, 120), (1, 0), (None, 0)}
    assert substring.op8_fm_passages(docs.limit(0)).collect() == []


def test_index_counts_like_a_scan():
    import numpy as np

    r = np.random.default_rng(2)
    sequences = [r.integers(0, 3, n).astype(np.uint64) for n in (30, 5, 12, 40, 1)]
    values = np.array([7, 3, 9, 1, 0])
    got = fmindex.FMIndex(sequences, values, 4).smallest()
    for s, out in zip(sequences, got, strict=True):
        want = [min(v for t, v in zip(sequences, values, strict=True)
                    if any((t[j:j + 4] == s[i:i + 4]).all() for j in range(len(t) - 3))) for i in range(len(s) - 3)]
        assert out.tolist() == want


# chat

def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "hi <|end|> \\"), (1, 1, "assistant", "<|turn|>\n\\|<|"), (1, 2, "user", None),
            (2, 0, "system", "x"), (2, 5, "assistant", "é🙂"), (2, 5, "assistant", "é🙂"), (2, 7, "assistant", ""),
            (3, 0, "user", "only"), (None, None, None, "t"), (4, 2, "a<|text|>b", "y"), (4, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.prefix_examples(df.withColumn("turns", F.lit(1))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] if r[1] is not None else -1)):
        want.setdefault(c, []).append((role or "", text or ""))
    back = {r.conv_id: r for r in chat.read_back(spark.createDataFrame(examples, "conv_id long, example int, formatted string, "
                                                                                "loss_start long, loss_end long")).collect()}
    for c, turns in want.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].trained == [t for r, t in turns if r == "assistant"]
    trained = [e for e in examples if e.conv_id == 2]
    assert [e.formatted[e.loss_start:e.loss_end] for e in sorted(trained, key=lambda e: e.example)] == ["é🙂", "é🙂", ""]
    assert [e.loss_start for e in examples if e.conv_id == 3] == [None]
    assert {r.conv_id for r in chat.op9_prefix_examples(df.limit(0)).collect()} == {-7}


# token counts

def test_tokens_sum_and_cross(spark, odd_docs):
    encode, _ = token_counts.encoder(token_counts.VOCABULARY)
    docs = sf(spark, "documents").select("doc_id", "text").union(odd_docs.select("doc_id", "text").filter("doc_id != 8"))
    texts = Counter()
    for r in docs.collect():
        if r.text is not None:
            texts[len(encode(r.text))] += 1
    for rule in token_counts.RULES:
        rows = token_counts.section_tokens(docs.withColumn("section", F.lit(1)).withColumn("n_tokens", F.lit(2)), rule=rule)
        per = rows.groupBy().agg(F.sum("n_tokens")).first()[0]
        assert abs(per - sum(n * k for n, k in texts.items())) < 1e-6 * per
    assert token_counts.op10_section_tokens(docs.limit(0)).collect() == []


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u2003", " \n"])
def test_long_blank_runs_are_cut_as_the_pattern_cuts_them(monkeypatch, blank):
    encode, size = token_counts.encoder(token_counts.VOCABULARY)
    text = "one" + blank * 300 + "two" + blank * 200
    plain = encode(text)
    monkeypatch.setattr(token_counts, "BLANKS", re.compile(token_counts.BLANKS.pattern.replace(str(token_counts.LONG_BLANK), "3")))
    assert encode(text) == plain and size[plain].sum() == len(text.encode())


@pytest.mark.parametrize("unit", [" ", "\n", "x", "7", "\n "])
def test_texts_of_five_million_characters(spark, unit):
    text = "a" + unit * (5_000_000 // len(unit)) + "b\nlast"
    rows = token_counts.op10_section_tokens(spark.createDataFrame([(1, text)], DOCS)).agg(
        F.sum("n_tokens"), F.max("byte_end"), F.sum(F.col("byte_end") - F.col("byte_start"))).first()
    encode, _ = token_counts.encoder(token_counts.VOCABULARY)
    assert tuple(rows) == (len(encode(text)), len(text), len(text))


def test_crossing_tokens_follow_the_rule():
    import numpy as np

    ends, sections = np.array([4, 10, 12]), np.array([6, 12])
    assert token_counts.attribute(ends, sections, "first").tolist() == [2, 1]
    assert token_counts.attribute(ends, sections, "most").tolist() == [1, 2]
    assert np.allclose(token_counts.attribute(ends, sections, "split"), [1 + 2 / 6, 4 / 6 + 1])
    assert token_counts.line_ends(b"a\nb\n").tolist() == [2, 4] and token_counts.line_ends(b"").tolist() == [0]
