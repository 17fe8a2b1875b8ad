"""Ranked lexical search by hashed max-sketches.

Terms are the maximal matches of ``TERM``, A-Z lower-cased.  A document's impact of a term is
(1000000000 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * N) div L; its score for an item is the
sum of w * impact over the item's distinct terms, w = floor(1000 ln((2N + 2) / (2df + 1))).

1. Each document folds into a sketch of ``COORDINATES`` hashed coordinates, stored sparse: a
   coordinate keeps the largest tf of its terms.  Within a document the impact grows with tf
   alone, so this is the coordinatewise maximum of its impacts, whatever N and L turn out to be.
   The same pass keeps the document's terms on coordinates that items use, for exact scores.
2. Items are looked up in blocks of about ``BLOCK_PAIRS`` terms: the sum of w * impact over
   the coordinates of an item's terms is an upper bound of the document's score, too high only
   where a larger tf shares a coordinate.
3. A task takes an item's documents by descending bound and scores them exactly, until the bound
   falls below the item's threshold: the TOP-th best exact score that the task knows.  Thresholds
   start from those of one document in ``SEED_SHARE``, a true lower limit, so tasks that hold
   no good document return nothing.  Their best rows are merged in two steps.

Every document is bounded and none is dropped unless its bound proves it is not among the best.

Defined cases: a null or termless text counts for nothing and is never found.  Every row is
a document: rows that share a doc_id are ranked each; a null doc_id comes after others of
equal score.  Rows of items that share an item_id (null too) are one item with all their terms;
an item without terms, or whose terms no document holds, has no rows.  Empty tables
give no rows.  Other columns of the inputs are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import Store
from flowlens.llm.textbatch import REMEMBERED, lists, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_RE = re.compile(TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COORDINATES = 1 << 16
TOP = 50
#: Terms of the items that are looked up together, about; cells and summands of one matrix of bounds.
BLOCK_PAIRS, CELLS = 200_000, 2_000_000
#: One document in so many is ranked first, for thresholds to start from.
SEED_SHARE = 64
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[str]:
    return TERM_RE.findall(text.translate(LOWER)) if text else []


class Places(dict):
    """The coordinates of terms, remembered within a bound."""

    def __missing__(self, term: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[term] = p = xxhash.xxh3_64_intdigest(term) % COORDINATES
        return p


def fold(counts: dict[str, int], places: Places) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of a document's sketch, in order, and their largest tf."""
    at = np.fromiter(map(places.__getitem__, counts), np.int64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    order = np.argsort(at, kind="stable")
    at, tf = at[order], tf[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.maximum.reduceat(tf, first) if len(first) else tf


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _sketches(used: np.ndarray):
    """Sketches, and the terms on the coordinates in ``used``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for whole in batches:
            for batch in slices(whole):
                counted = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
                folded = [fold(c, places) for c in counted]
                held = [[t for t in c if used[places[t]]] for c in counted]
                sizes, kept = np.array([len(f[0]) for f in folded]), np.array([len(h) for h in held])
                flat = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([c.total() for c in counted], pa.int64()),
                    lists(flat([f[0] for f in folded]).astype(np.int32), sizes, pa.int32()),
                    lists(flat([f[1] for f in folded]).astype(np.int32), sizes, pa.int32()),
                    lists([t for h in held for t in h], kept, pa.string()),
                    lists(flat([[c[t] for t in h] for c, h in zip(counted, held, strict=True)]).astype(np.int32), kept, pa.int32())],
                    ["doc_id", "n", "places", "most", "terms", "tf"])
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            flat = [t for f in found for t in f]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner)), pa.array(flat, pa.string()),
                pa.array([xxhash.xxh3_64_intdigest(t) % COORDINATES for t in flat], pa.int32())], ["item_id", "term", "place"])


class Block:
    """Items that are looked up together: their terms, weights and coordinates."""

    def __init__(self, rows: list):
        self.items = list(dict.fromkeys(r.item_id for r in rows))
        number = {item: i for i, item in enumerate(self.items)}
        self.terms: list[dict[str, int]] = [{} for _ in self.items]
        for r in rows:
            self.terms[number[r.item_id]][r.term] = r.w
        place = np.array([r.place for r in rows], np.int64)
        order = np.argsort(place, kind="stable")
        self.item = np.array([number[r.item_id] for r in rows], np.int64)[order]
        self.w = np.array([r.w for r in rows], np.float64)[order]
        #: The entries of coordinate c stand from starts[c] to starts[c + 1].
        self.starts = np.searchsorted(place[order], np.arange(COORDINATES + 1))

    def pieces(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in pieces of CELLS cells and summands of bounds, or of one row."""
        places = np.asarray(batch.column(2).flatten()).astype(np.int64)
        summands = np.concatenate([[0], np.cumsum(self.starts[places + 1] - self.starts[places])])
        ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()))])
        load = summands[ends] + np.arange(len(ends)) * len(self.items)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(load, load[at] + CELLS, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to

    def bounds(self, owner: np.ndarray, places: np.ndarray, impacts: np.ndarray, rows: int) -> np.ndarray:
        """Upper bounds of rows' scores for each item; a sketch's coordinates stand flat, with the row that owns each."""
        entries = self.starts[places + 1] - self.starts[places]
        hit = np.flatnonzero(entries)
        counts = entries[hit]
        ends = np.cumsum(counts)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places[hit]] - ends + counts, counts)
        cell = np.repeat(owner[hit], counts) * len(self.items) + self.item[entry]
        # Sums of integers far below 2^53 are exact; beyond, they may round by a part in 2^52 a term.
        total = np.bincount(cell, self.w[entry] * np.repeat(impacts[hit], counts), rows * len(self.items))
        return np.where(total < 2**52, total, total * (1 + 1e-9)).reshape(rows, len(self.items))


def _best(block, seeds: dict, n_docs: int, n_terms: int, top: int, kinds: tuple):
    """The rows of a partition that may be among an item's best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best: list[list] = [[] for _ in b.items]
        least = [seeds.get(item) for item in b.items]

        def limit(i: int):
            full = best[i][0] if len(best[i]) == top else None
            return max(full, least[i]) if full and least[i] else full or least[i] or (1, -NO_ID)

        limits = np.array([limit(i)[0] for i in range(len(b.items))], np.float64)
        for whole in batches:
            for batch in b.pieces(whole):
                ids = np.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], np.int64)
                m = 50 + 50 * np.asarray(batch.column(1)) * n_docs // max(1, n_terms)
                sizes = np.asarray(batch.column(2).value_lengths())
                owner = np.repeat(np.arange(len(batch)), sizes)
                places, most = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3))
                bounds = b.bounds(owner, places, impact(most, m[owner]).astype(np.float64), len(batch))
                own: dict[int, dict[str, int]] = {}
                for i in np.flatnonzero((bounds >= limits).any(0)):
                    rows = np.flatnonzero(bounds[:, i] >= limits[i])
                    for r in rows[np.lexsort((ids[rows], -bounds[rows, i]))]:
                        low = limit(i)
                        if bounds[r, i] < low[0]:
                            break
                        if (bounds[r, i], -int(ids[r])) < low:
                            continue
                        if r not in own:
                            own[r] = dict(zip(batch.column(4)[r].as_py(), batch.column(5)[r].as_py(), strict=True))
                        tf, mr = own[r], int(m[r])
                        score = sum(w * impact(tf[t], mr) for t, w in b.terms[i].items() if t in tf)
                        entry = (score, -int(ids[r]))
                        if score > 0 and entry >= (least[i] or entry):
                            if len(best[i]) < top:
                                heapq.heappush(best[i], entry)
                            else:
                                heapq.heappushpop(best[i], entry)
                    limits[i] = limit(i)[0]
        flat = [(b.items[i], None if d == -NO_ID else -d, score) for i, rows in enumerate(best) for score, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], kind) for c, kind in enumerate((*kinds, pa.int64()))],
                                         ["item_id", "doc_id", "score"])
    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_pairs: int = BLOCK_PAIRS,
           seed_share: int = SEED_SHARE) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best rows of docs (doc_id, text); doc_id is an integer."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    store = Store(spark, "search")
    item_type, id_type = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    kinds = (to_arrow_type(item_type), to_arrow_type(id_type))
    wanted = store.keep(items.select("item_id", "text").mapInArrow(
        _item_terms, f"item_id {item_type.simpleString()}, term string, place int").distinct(), "item-terms")
    # At most COORDINATES numbers.
    used = np.zeros(COORDINATES, bool)
    used[[r.place for r in wanted.select("place").distinct().collect()]] = True
    made = store.keep(docs.select("doc_id", "text").mapInArrow(
        _sketches(used), f"doc_id {id_type.simpleString()}, n long, places array<int>, most array<int>, terms array<string>, "
        "tf array<int>").filter("n > 0"), "sketches")
    n_docs, n_terms = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = made.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = store.keep(wanted.join(df, "term").withColumn(
        "w", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")), "weights")
    blocks = -(-weighed.count() // block_pairs)
    schema = f"item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long"
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())

    def merged(rows: DataFrame) -> DataFrame:
        # A part of the tasks' rows first, so that an item's rows of all tasks never meet in one.
        rows = rows.withColumn("part", F.spark_partition_id() % 64)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
        rows = rows.filter(F.col("rank") <= top).drop("part")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
        return rows.filter(F.col("rank") <= top)

    out = None
    for n in range(blocks):
        mine = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        block = Block(mine.select("item_id", "term", "place", "w").orderBy("item_id", "term").collect())
        held = spark.sparkContext.broadcast(block)
        first = made.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seed_share)) == 0)
        first = merged(first.mapInArrow(_best(held, {}, n_docs, n_terms, top, kinds), schema))
        seeds = {r.item_id: (r.score, -NO_ID if r.doc_id is None else -r.doc_id)
                 for r in first.filter(F.col("rank") == top).collect()}
        rows = merged(made.mapInArrow(_best(held, seeds, n_docs, n_terms, top, kinds), schema))
        rows = store.keep(rows, f"block-{n}")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_max_sketches(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
counted AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM counted),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM counted) GROUP BY ALL),
item_terms AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM item_terms) GROUP BY t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, corpus),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item_terms JOIN weights USING (t) JOIN tf USING (t), corpus GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 50"""
