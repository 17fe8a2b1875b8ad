"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct ``SHINGLE``-word shingles (64-bit hashes); texts
with fewer words have one shingle, texts without words the empty set.  Two
documents are linked if 100 * |intersection| >= percent * |union|.

1. Equal sets collapse to one class (partial aggregation by a 128-bit digest), so
   a group of copies, however large, costs one representative.
2. Each representative has ``rows * bands`` MinHash samples.  Bands of samples make
   buckets; ``bands`` follows from the threshold, so that a pair at the threshold
   shares no bucket with a probability below ``MISS``.  The samples also fold into
   an odd sketch: each sample flips one of ``SKETCH_BITS`` parity bits.  The
   population count z of two sketches' XOR estimates how many samples differ,
   -n/2 ln(1 - 2z/n) of 2k, and from that the similarity; at high similarity few
   bits are set, which is where odd sketches are precise.
3. Within a bucket, one centre is compared with the other members: sketches first,
   within ``SIGMAS`` standard deviations, then the full sets of those that pass.  The
   centre is the member that knows most others over all its buckets, as the text that
   copies were made from does.  Confirmed links merge classes (connected components).
4. In the buckets that still hold several components, the members outside the largest
   ask all others in the same way, in blocks of bounded size; a task returns only links
   that connect.  After that every pair of a bucket is of one component or compared.

Full sets are built for members of passing pairs and of such buckets only.

Sets are known by a 128-bit digest throughout; a component takes the smallest doc_id of its sets at the end.

Defined cases: a null text has no words; empty sets link with nothing.  Rows that
share a doc_id are one document: the sets of all its texts are linked; each row is returned.  A row with a null
doc_id is compared with nothing: its component_id is null and it is kept.
Repeated rows have equal sets and ids, so both say kept or both do not.  An empty
table gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Store
from flowlens.llm.textbatch import WordHashes, lists, mix, slices, split, windows

SHINGLE = 5
ROWS = 6
MISS = 1e-6
SKETCH_BITS = 512
SIGMAS = 6.0
#: Askers and members of a bucket that one task compares.
BLOCK, CHUNK = 1_000, 4_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_set(text: str | None, seen: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, ASCII letters lower-cased."""
    words = split(text.translate(LOWER) if text else None)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(seen.of(words), min(SHINGLE, len(words))) + np.uint64(len(words) < SHINGLE))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(rows: int, bands: int):
    k = rows * bands
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, k, np.uint32)
    salt = rng.integers(0, 2**63, k, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_set(t, seen) for t in batch.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                digests = [digest(s) for s in sets]
                full = np.flatnonzero(sizes)
                keys, sketch = np.empty((len(full), bands), np.int64), np.empty((len(full), SKETCH_BITS // 64), np.int64)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    x = (x >> np.uint64(32)).astype(np.uint32)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    least = np.empty((len(full), k), np.uint64)
                    for j in range(k):
                        least[:, j] = np.minimum.reduceat(x * a[j] + b[j], starts)
                    salted = mix(least + salt)
                    bits = np.zeros((len(full), SKETCH_BITS), np.uint8)
                    np.add.at(bits, (np.arange(len(full))[:, None], (salted % np.uint64(SKETCH_BITS)).astype(np.int64)), 1)
                    sketch = np.packbits(bits & 1, axis=1).view(np.int64)
                    part = salted.reshape(len(full), bands, rows)
                    key = part[:, :, 0]
                    for r in range(1, rows):
                        key = mix(key * np.uint64(3) + part[:, :, r])
                    keys = (key + np.arange(bands, dtype=np.uint64)).view(np.int64)
                some = (sizes > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    lists(keys.ravel(), some * bands, pa.int64()),
                    lists(np.ascontiguousarray(sketch).ravel(), some * (SKETCH_BITS // 64), pa.int64())],
                    ["doc_id", "n_shingles", "set", "bands", "sketch"])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHashes()
    for whole in batches:
        for batch in slices(whole):
            sets = [shingle_set(t, seen) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()),
                                              lists(flat, np.array([len(s) for s in sets]), pa.int64())], ["id", "shingles"])


def _estimate(a: Column, b: Column, samples: int) -> Column:
    """The similarity that two odd sketches speak for."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = F.greatest(1 - 2 * z / F.lit(float(SKETCH_BITS)), F.lit(1e-9))
    return 1 + F.log(share) * (SKETCH_BITS / 2 / (2 * samples))


def near_duplicates(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    store = Store(spark, "neardup")
    bands = bands_for(percent)
    samples, limit = ROWS * bands, percent / 100
    lowest = limit - SIGMAS * math.sqrt(limit * (1 - limit) / samples)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    made = store.keep(texts.mapInArrow(
        _sketches(ROWS, bands), f"doc_id {kind}, n_shingles long, set binary, bands array<long>, sketch array<long>"), "sketches")
    named = made.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # One row per set; the smallest doc_id stands for it.
    classes = store.keep(named.groupBy("set").agg(F.min("doc_id").alias("least")), "classes")
    reps = named.join(classes.select(F.col("least").alias("doc_id"), "set"), ["doc_id", "set"])
    members = reps.select(F.explode("bands").alias("bucket"), F.col("set").alias("id")).distinct()
    shared = members.groupBy("bucket").count().filter("count > 1")
    members = store.keep(members.join(shared, "bucket"), "members")
    # How many neighbours a member has, over its buckets.  The text that a group's others were made from has most.
    known = members.groupBy("id").agg(F.sum("count").alias("known"))
    members = store.keep(members.drop("count").join(known, "id"), "known-members")
    sketches = reps.select(F.col("set").alias("id"), "sketch", "bands").dropDuplicates(["id"])
    sketches = store.keep(sketches.join(members.select("id").distinct(), "id"), "members-sketches")

    # The sets of a doc_id that has several texts are linked.
    several = named.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a < b").select("doc_id", "a")
    ties = store.keep(named.join(several, "doc_id").select("a", F.col("set").alias("b")).filter("a != b").distinct(), "ties")
    ids = members.select("id").union(ties.select("a")).union(ties.select("b")).distinct()
    labels = ids.withColumn("comp", F.col("id"))

    centres = members.groupBy("bucket").agg(F.max_by("id", F.struct("known", "id")).alias("centre"))
    pairs = (members.join(centres, "bucket").filter("id != centre")
             .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
    likely = (pairs.join(sketches.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a")
              .join(sketches.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
              .filter(_estimate(F.col("sa"), F.col("sb"), samples) >= lowest).select("a", "b"))
    likely = store.keep(likely, "likely")
    wanted = store.keep(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct(),
                        "wanted")
    sets = store.keep(_sets_of(store, texts, wanted, classes), "sets")
    both = (likely.join(sets.withColumnsRenamed({"id": "b", "shingles": "tb"}), "b")
            .join(sets.withColumnsRenamed({"id": "a", "shingles": "ta"}), "a")
            .withColumn("n", F.size(F.array_intersect("ta", "tb"))))
    links = both.filter(F.col("n") * 100 >= percent * (F.size("ta") + F.size("tb") - F.col("n"))).select("a", "b")
    labels = _merge(store, labels, store.keep(links.union(ties), "links"))

    rest = _open(store, members, labels)
    wanted = store.keep(rest.select("id").distinct(), "wanted")
    more = _sets_of(store, texts, wanted.join(sets, "id", "left_anti"), classes)
    sets = store.keep(more.unionByName(sets.join(wanted, "id", "left_semi")), "sets")
    rest = rest.join(sets.join(sketches, "id"), "id")
    links = rest.groupBy("bucket", "block", "chunk").applyInArrow(
        _compare(percent, samples, lowest), "a binary, b binary").distinct()
    labels = _merge(store, labels, store.keep(links, "links"))

    labelled = classes.join(labels.withColumnRenamed("id", "set"), "set")
    components = labelled.groupBy("comp").agg(F.min("least").alias("component"))
    of_set = labelled.join(components, "comp").select("set", "component")
    of_class = classes.join(of_set, "set", "left").select("set", F.coalesce("component", "least").alias("component"))
    out = made.drop("bands", "sketch").join(of_class, "set", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.withColumn("component_id", component).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets_of(store: Store, texts: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """id and shingles of the sets in ``wanted``, made anew from the texts of their smallest doc_ids."""
    # Written, so that its size is known: few ids are broadcast instead of shuffling all texts.
    named = store.keep(wanted.join(classes.withColumnRenamed("set", "id"), "id").select("least").distinct(), "set-owners")
    rows = texts.join(named, texts["doc_id"] == named["least"], "left_semi")
    made = rows.mapInArrow(_sets, "id binary, shingles array<long>").join(wanted, "id", "left_semi")
    return made.groupBy("id").agg(F.min("shingles").alias("shingles"))


def _open(store: Store, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The comparisons left: bucket, block, chunk, id, comp and asks.

    In a bucket of several components, the members outside its largest ask all others.
    Askers are dealt to blocks and members to chunks of bounded sizes; each asker meets
    each chunk once and each member each block.
    """
    labelled = members.join(labels, "id")
    per = labelled.groupBy("bucket", "comp").count().groupBy("bucket").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps"),
        F.sum("count").alias("n"), F.max("count").alias("most")).filter("comps > 1")
    per = per.select("bucket", "largest", F.ceil((F.col("n") - F.col("most")) / F.lit(BLOCK)).alias("blocks"),
                     F.ceil(F.col("n") / F.lit(CHUNK)).alias("chunks"))
    rows = store.keep(labelled.join(per, "bucket").select(
        "bucket", "id", "comp", (F.col("comp") != F.col("largest")).alias("asks"), "blocks", "chunks",
        F.pmod(F.xxhash64("id"), F.col("blocks")).alias("own_block"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).alias("own_chunk")), "open")
    asked = rows.withColumn("asks", F.lit(False)).withColumnRenamed("own_chunk", "chunk").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asking = rows.filter("asks").withColumnRenamed("own_block", "block").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    columns = ["bucket", "block", "chunk", "id", "comp", "asks"]
    return asked.select(*columns).unionByName(asking.select(*columns))


def _compare(percent: int, samples: int, lowest: float):
    """Links between the askers of a block and the members of a chunk.

    A pair that shares several buckets is compared in the first of them; pairs of one
    component, or that a link found here connects, are not compared.
    """
    def column(table: pa.Table, name: str) -> np.ndarray:
        lists = table.column(name).combine_chunks()
        return np.asarray(lists.flatten()).reshape(len(table), -1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        ids, comps = table.column("id").to_pylist(), table.column("comp").to_pylist()
        asks = np.asarray(table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
        bands, sketch = column(table, "bands"), column(table, "sketch").view(np.uint64)
        sets = [np.sort(np.asarray(s.values).view(np.uint64)) for s in table.column("shingles").combine_chunks()]
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        root = list(range(len(number)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        comp = np.array([number[c] for c in comps])
        order = {d: i for i, d in enumerate(sorted(set(ids)))}
        rank = np.array([order[d] for d in ids])
        asking = {ids[i] for i in np.flatnonzero(asks)}
        also = np.array([d in asking for d in ids])
        others = np.flatnonzero(~asks)
        here = int(np.flatnonzero(bands[0] == bucket)[0])
        links = []
        for q in np.flatnonzero(asks):
            t = others[(comp[others] != comp[q]) & (~also[others] | (rank[others] > rank[q]))]
            t = t[~(bands[t, :here] == bands[q, :here]).any(1)]
            z = np.bitwise_count(sketch[t] ^ sketch[q]).sum(1)
            guess = 1 + np.log(np.maximum(1 - 2 * z / SKETCH_BITS, 1e-9)) * (SKETCH_BITS / 2 / (2 * samples))
            for i in t[guess >= lowest]:
                u, v = find(comp[q]), find(comp[i])
                if u == v:
                    continue
                x, y = sets[q], sets[i]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                n = int((x[at] == y).sum())
                if n * 100 >= percent * (len(x) + len(y) - n):
                    root[max(u, v)] = min(u, v)
                    links.append((min(ids[q], ids[i]), max(ids[q], ids[i])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})
    return run


def _merge(store: Store, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after joining the components that links connect.

    Alternating large-star and small-star steps on the graph of components: each keeps the
    components as they are and ends with every node linked to its smallest.
    """
    ca, cb = labels.withColumnsRenamed({"id": "a", "comp": "u"}), labels.withColumnsRenamed({"id": "b", "comp": "v"})
    edges = links.join(ca, "a").join(cb, "b").select("u", "v").filter("u != v").distinct()
    edges = store.keep(edges, "edges")
    if edges.isEmpty():
        return labels
    before = None
    while True:
        # Large star: of each node, larger neighbours link to the smallest of it and its neighbours.
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        large = store.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store.keep(others.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    smaller = edges.groupBy("u").agg(F.min("v").alias("to"))
    return store.keep(labels.join(smaller, labels["comp"] == smaller["u"], "left")
                      .select("id", F.coalesce("to", "comp").alias("comp")), "labels")


def op2_odd_sketches(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 85)


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each group of near-duplicates does.

    Of rows that share the staying doc_id, as of repeated rows, one stays: that of the smallest hash.
    """
    verdict = near_duplicates(docs, percent).select("doc_id", "kept").distinct()
    named = docs.filter(docs["doc_id"].isNotNull())
    kept = named.join(verdict.filter("kept").select("doc_id"), "doc_id", "left_semi")
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(docs.filter(docs["doc_id"].isNull()))
