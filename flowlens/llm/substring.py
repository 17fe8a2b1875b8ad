"""Substring dedup: repeated passages by FM-index shards.

A window is ``WINDOW`` consecutive words.  Words covered by a window that also starts
in a document of a smaller id are removed.

1. Every window has an anchor, the smallest hash of its ``GRAM``-word runs.  Equal
   windows have equal anchors, so consecutive windows with one anchor (a fragment)
   hold what can repeat, and only anchors of several documents matter.  Those are
   found by a partial aggregation over one row per fragment; texts without such
   anchors go no further.
2. Fragments go to shards by anchor, equal ones once.  A shard has an FM-index over
   its fragments; the fragments are streamed through it by backward search over
   the wavelet matrix.  The matching statistic (capped at ``WINDOW``) and its rows
   give, for each window, the smallest id that holds it.
3. Windows whose smallest id is below the document's own are its intervals to remove.

A shard holds about ``SHARD_WORDS`` words.  An anchor with more than ``HOT_WORDS`` words
of different fragments would not fit in one; its windows are grouped one by one, by
their 128-bit digest, with partial aggregation instead.  Fragments are cut at
``MOST_WINDOWS`` windows, which bounds the steps of a search, not what is found.

Defined cases: a null text has no words; texts shorter than a window keep all.
Rows that share a doc_id are no smaller than each other, so repeated rows keep
what only they hold.  Rows with a null doc_id neither lose words nor cause others
to.  doc_id is an integer.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Store
from flowlens.llm.fmindex import FMIndex
from flowlens.llm.textbatch import WordHashes, lists, slices, split, windows

WINDOW = 50
GRAM = 8
SHARD_WORDS = 400_000
HOT_WORDS = 1_200_000
MOST_WINDOWS = 512


def fragments(h: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each fragment of a text's word hashes."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, span, size = windows(h, gram), window - gram + 1, 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < span:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.append(first, len(least)))
    if counts.max() > MOST_WINDOWS:
        first = np.concatenate([np.arange(a, a + n, MOST_WINDOWS) for a, n in zip(first, counts, strict=True)])
        counts = np.diff(np.append(first, len(least)))
    return least[first], first, counts


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def _read(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for whole in batches:
            for batch in slices(whole, 2):
                texts = [split(t) for t in batch.column(2).to_pylist()]
                found = [fragments(seen.of(w), window) for w in texts]
                counts = np.array([len(f[0]) for f in found])
                column = lambda i: np.concatenate([*[f[i] for f in found], np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([_digest(w) for w in texts]),
                    lists(np.concatenate([*[f[0] for f in found], np.empty(0, np.uint64)]).view(np.int64), counts, pa.int64()),
                    lists(column(1).astype(np.int32), counts, pa.int32()),
                    lists(column(2).astype(np.int32), counts, pa.int32())],
                    ["doc_id", "t", "n_words", "sha", "anchors", "firsts", "counts"])
    return run


def _cut(window: int):
    """The words of a text's fragments whose anchors repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for whole in batches:
            for batch in slices(whole, 2):
                ids, ts, anchors, at, words, hi, lo = [], [], [], [], [], [], []
                for doc_id, t, text, places in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    h = seen.of(split(text))
                    for p in places:
                        piece = h[p["first"]:p["first"] + p["count"] + window - 1]
                        d = xxhash.xxh3_128_intdigest(piece.tobytes())
                        ids.append(doc_id)
                        ts.append(t)
                        anchors.append(p["anchor"])
                        at.append(p["first"])
                        words.append(piece)
                        hi.append(d >> 64)
                        lo.append(d & (2**64 - 1))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), pa.array(anchors, pa.int64()),
                    pa.array(at, pa.int32()), signed(hi), signed(lo),
                    lists(np.concatenate([*words, np.empty(0, np.uint64)]).view(np.int64),
                          np.array([len(w) for w in words], np.int64), pa.int64())],
                    ["doc_id", "t", "anchor", "first", "hi", "lo", "words"])
    return run


def _search(window: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        words = shard.column("words").combine_chunks()
        flat = np.asarray(words.values).view(np.uint64)
        offsets = np.asarray(words.offsets)
        sequences = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        found = FMIndex(sequences, np.asarray(shard.column("least")), window).smallest()
        return pa.table({
            "anchor": shard.column("anchor"), "hi": shard.column("hi"), "lo": shard.column("lo"),
            "smallest": lists(np.concatenate(found), np.array([len(f) for f in found]), pa.int64())})
    return run


def _removed(window: int):
    """Texts without the words of the windows at ``starts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                kept, sha = [], []
                for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = split(text)
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.array(starts, np.int64))
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    rest = [words[i] for i in stay]
                    kept.append(" ".join(rest))
                    sha.append(_digest(rest))
                removed = [len(split(t)) - len(split(k)) for t, k in zip(batch.column(2).to_pylist(), kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                     pa.array(sha)], ["r_id", "r_t", "n_removed", "kept", "r_sha"])
    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                      hot_words: int = HOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """What each row has (doc_id, t, n_words, sha) and, of the texts that lose words, r_id, r_t, n_removed, kept and r_sha.

    t is a hash of the text: rows that share a doc_id may differ in it.
    """
    spark = docs.sparkSession
    store = Store(spark, "substring")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("t"),
                        docs[text_col].alias("text"))
    rows = store.keep(texts.mapInArrow(
        _read(window), "doc_id long, t long, n_words long, sha string, anchors array<long>, firsts array<int>, counts array<int>"),
        "rows")
    places = rows.filter("doc_id IS NOT NULL").select("doc_id", "t", F.inline(F.arrays_zip(
        F.col("anchors").alias("anchor"), F.col("firsts").alias("first"), F.col("counts").alias("count"))))
    shared = (places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
              .filter("a < b").select("anchor"))
    wanted = (places.join(shared, "anchor").distinct().groupBy("doc_id", "t")
              .agg(F.collect_list(F.struct("anchor", "first", "count")).alias("places")))
    held = store.keep(texts.join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
                      .select("doc_id", "t", "text", "places"), "held")
    cut = store.keep(held.mapInArrow(
        _cut(window), "doc_id long, t long, anchor long, first int, hi long, lo long, words array<long>"), "cut")
    once = store.keep(cut.groupBy("anchor", "hi", "lo").agg(F.min("doc_id").alias("least"), F.min("words").alias("words")),
                      "once")
    sizes = once.groupBy("anchor").agg(F.sum(F.size("words")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = store.keep(sizes.filter(F.col("n") > hot_words).select("anchor"), "hot")
    shards = max(1, math.ceil(total / SHARD_WORDS))
    sharded = once.join(hot, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    smallest = (sharded.repartition(shards, "shard").groupBy("shard")
                .applyInArrow(_search(window), "anchor long, hi long, lo long, smallest array<long>"))
    if not hot.isEmpty():
        smallest = smallest.unionByName(_one_by_one(once.join(hot, "anchor"), window))
    smallest = store.keep(smallest, "smallest")
    before = F.array_compact(F.transform("smallest", lambda m, i: F.when(m < F.col("doc_id"), F.col("first") + i)))
    starts = (cut.drop("words").join(smallest, ["anchor", "hi", "lo"]).select("doc_id", "t", before.alias("starts"))
              .filter(F.size("starts") > 0).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    losing = held.select("doc_id", "t", "text").join(starts, ["doc_id", "t"])
    return rows.select("doc_id", "t", "n_words", "sha"), losing.mapInArrow(
        _removed(window), "r_id long, r_t long, n_removed long, kept string, r_sha string")


def _one_by_one(once: DataFrame, window: int) -> DataFrame:
    """The smallest ids of fragments, by grouping their windows."""
    one = once.select("anchor", "hi", "lo", "least", "words", F.explode(
        F.sequence(F.lit(1), F.size("words") - window + 1)).alias("i"))
    piece = F.slice("words", F.col("i"), window)
    one = one.select("anchor", "hi", "lo", "least", "i", F.xxhash64(piece).alias("x"),
                     F.xxhash64(F.lit(1), F.reverse(piece)).alias("y"))
    least = one.groupBy("x", "y").agg(F.min("least").alias("smallest"))
    return (one.join(least, ["x", "y"]).groupBy("anchor", "hi", "lo")
            .agg(F.sort_array(F.collect_list(F.struct("i", "smallest"))).alias("s"))
            .select("anchor", "hi", "lo", F.col("s.smallest").alias("smallest")))


def op8_fm_passages(docs: DataFrame) -> DataFrame:
    """Of every row: n_words, n_removed and the SHA-256 of the words it keeps."""
    rows, losing = repeated_passages(docs)
    losing = losing.select("r_id", "r_t", "n_removed", "r_sha")
    out = rows.join(losing, (rows["doc_id"] == losing["r_id"]) & (rows["t"] == losing["r_t"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("r_sha", "sha").alias("kept_sha256"))
