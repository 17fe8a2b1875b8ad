"""The pipeline's stages, each on its own input, against code that shares nothing with the operators."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from llm_inputs import SF_SMALL, odd_docs, prose  # noqa: F401
from test_operators import WORD, base, brute_targets, components, least_capacity


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def kept(spark):
    """The pipeline's input and what each stage made of its predecessor's rows."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF_SMALL)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    assert all(k.columns == docs.columns for k in out[:-1])
    return [k.collect() for k in out]


def test_quality_rules_drop_what_the_base_rule_fails_and_keep_clean_rows(spark, kept):
    start, good = kept[0], {r.doc_id for r in kept[1]}
    passing = {r.doc_id for r in start if not base(r.text)[5]}
    assert good <= passing
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    clean = {d for d in passing if quality.get(d) == 1}
    assert len(good & clean) >= 0.97 * len(clean)
    assert [r for r in start if r.doc_id in good] == sorted(kept[1], key=lambda r: r.doc_id)


def test_one_document_of_each_near_duplicate_group_stays(kept):
    want = components([(r.doc_id, r.text) for r in kept[1]], 80)
    assert {r.doc_id for r in kept[2]} == {d for d, (_, c) in want.items() if d == c}
    assert len({r.doc_id for r in kept[2]}) == len(kept[2])


def test_documents_with_benchmark_text_go(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in kept[2] if any(t in r.text for t in items)}
    # No shingle of any item: certainly clean.
    shingles = {tuple(w[i:i + 5]) for w in (words(t.lower()) for t in items) for i in range(len(w) - 4)}
    clean = {r.doc_id for r in kept[2] if not shingles & {tuple(w[i:i + 5]) for w in [words(r.text.lower())] for i in range(len(w) - 4)}}
    left = {r.doc_id for r in kept[3]}
    assert clean <= left and not whole & left and whole


def test_rows_without_an_id_are_decontaminated(spark):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    rows = [(None, prose(1, 60) + " " + item, 1), (None, prose(2, 60), 2), (3, item, 3), (4, None, 4), (None, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked_text int")
    left = corpus_pipeline.decontaminate(spark, docs, SF_SMALL)
    assert left.columns == docs.columns and sorted(r.leaked_text for r in left.collect()) == [2, 4, 5]


def test_the_mix_takes_its_sources_targets(kept):
    sizes, taken = Counter(), Counter()
    copies = Counter(r.doc_id for r in kept[4])
    for r in kept[3]:
        sizes[r.source] += len(words(r.text))
        taken[r.source] += copies[r.doc_id] * len(words(r.text))
    want = brute_targets(dict(sizes))
    assert set(copies) <= {r.doc_id for r in kept[3]} and max(copies.values()) <= 2
    assert abs(sum(taken.values()) - sum(want.values())) <= 0.05 * sum(want.values())
    largest = {s: max(len(words(r.text)) for r in kept[3] if r.source == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_shards_take_every_row_within_the_least_capacity(kept):
    assert Counter(r.doc_id for r in kept[5]) == Counter(r.doc_id for r in kept[4])
    text = {r.doc_id: r.text for r in kept[4]}
    groups, loads, shard_of = Counter(), Counter(), {}
    for r in kept[5]:
        key = hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        groups[key] += len(text[r.doc_id].encode()) + 8
        loads[r.shard] += len(text[r.doc_id].encode()) + 8
        assert shard_of.setdefault(key, r.shard) == r.shard
    for s in loads:
        assert sorted(r.slot for r in kept[5] if r.shard == s) == list(range(sum(r.shard == s for r in kept[5])))
    if max(groups.values()) <= sum(groups.values()) / 24:
        assert max(loads.values()) == least_capacity([groups[k] for k in sorted(groups)], 24)
    else:
        assert max(loads.values()) >= max(groups.values()) and set(loads) <= set(range(24))


def test_stages_on_odd_rows(spark, odd_docs):
    """Rows without words go at the first stage; so does every short one; what is left passes on, null ids too."""
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF_SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "quality rules":
            assert {r.doc_id for r in docs.collect()} <= {4, 5, 6, 11, None}
            assert all(len(words(r.text)) >= 50 for r in docs.collect())
        elif name in ("near-duplicates", "decontamination"):
            assert docs.count() <= before
    assert docs.count() == len({(r.shard, r.slot) for r in docs.collect()})


def test_run_writes_each_stage(spark, kept):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.shard) for r in rows) == Counter((r.doc_id, r.shard) for r in kept[5])
