"""Sharding: minimax contiguous partition of atomic groups.

Equal texts form one atomic group (one shard holds all of them).  Groups are
ordered by the SHA-256 of their text, so every range of the order is as even
as the hash.  The smallest shard capacity for which a greedy left-to-right
fill needs no more than the wanted shards is found by binary search, and the
order is cut within that capacity: between where that fill cuts and where the
same fill from the right cuts, as near to the even share as possible.

A group larger than an even share of what is left sets the capacity by
itself and would leave other shards empty; such groups (fewer than the shard
count) come first in the order and take a shard each, and the search runs on
the rest with the remaining shards.

The prefix sums stay distributed.  The driver holds the sums of 4,097 hash
buckets, and of the prefix sums only those that a cut can fall on: bounds on
the capacity bound every cut's place.  While these are too many rows, batches
of capacities are tried against the stored prefix sums, which narrows the
bounds 64 times a round.

Defined cases: a null text counts no bytes, has checksum 0 and forms the
group of null texts; the empty text is a group of its own.  Repeated rows each
get a slot.  With fewer groups than shards the last shards stay empty; an
empty table gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import Store

SHARDS = 24
#: Prefix sums that the driver may hold at once.
NEAR_CUTS = 50_000
#: Capacities tried in one round against the stored prefix sums.
TRIES = 63
#: Cells per shard in which rows are numbered.
SLOT_CELLS = 256


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                   near_cuts: int = NEAR_CUTS) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard and slot (gapless from 0 within a shard) of every row."""
    store = Store(docs.sparkSession, "sharding")
    text = docs[text_col]
    rows = store.keep(docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("text_key")), "rows")
    groups = store.keep(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")), "groups")
    own, cuts = _cuts(store, groups, shards, near_cuts)
    return _number(rows.withColumn("shard", _shard_of(F.col("text_key"), own, cuts)))


def place_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, shard and slot of every row, beside its size and checksum; texts stay where they are.

    A trainer reads a shard's rows in the order of their slots.
    """
    return minimax_shards(docs, shards, id_col, text_col).select("doc_id", "size", "text_crc32", "shard", "slot")


def _shard_of(key: Column, own: list[str], cuts: list[str]) -> Column:
    """own: keys with a shard each; cuts: the last key of each further shard but the final one."""
    place = F.lit(len(own))
    for cut in cuts:
        place = place + (key > cut).cast("int")
    for i, k in enumerate(own):
        place = F.when(key == k, i).otherwise(place)
    return place.cast("int")


def _number(rows: DataFrame) -> DataFrame:
    """Slots from cell counts and ranks inside cells, so that no task sorts a whole shard."""
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLOT_CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "cell").count()
              .select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_key")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    # at most SHARDS * SLOT_CELLS rows
    return (ranked.join(F.broadcast(starts), ["shard", "cell"])
            .withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
            .select("doc_id", "size", "text_crc32", "text_key", "shard", "slot"))


def _cuts(store: Store, groups: DataFrame, shards: int, near_cuts: int) -> tuple[list[str], list[str]]:
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    largest = groups.orderBy(F.desc("group_size"), "text_key").limit(shards).collect()
    own: list[str] = []
    for g in largest:
        left = shards - len(own)
        if left == 1 or g.group_size * left <= total:
            break
        own.append(g.text_key)
        total -= g.group_size
    left = shards - len(own)
    if left == 1 or not total:
        return own, []
    most = next(g.group_size for g in largest if g.text_key not in own)

    rest = groups.filter(~F.col("text_key").isin(own)) if own else groups
    in_order = Window.partitionBy("bucket").orderBy("text_key")
    sums = store.keep(rest.withColumn("bucket", F.substring("text_key", 1, 3))
                      .withColumn("upto", F.sum("group_size").over(in_order)), "sums")
    by_bucket = sorted((r.bucket, r.s) for r in sums.groupBy("bucket").agg(F.max("upto").alias("s")).collect())
    names = [b for b, _ in by_bucket]
    edges = [0, *accumulate(s for _, s in by_bucket)]  # edges[i]: sum before bucket i
    floor_edge = lambda x: edges[bisect_right(edges, x) - 1]

    # Cuts at bucket edges alone give a feasible capacity; the largest group and the even share bound it from below.
    low = max(-(-total // left), most)
    high = low + most
    a, b = low, high
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if _fill(floor_edge, mid, left)[-1] >= total else (mid + 1, b)
    high = min(high, b)
    spans = [(p, min(total, (i + 1) * high)) for i, p in enumerate(_fill(floor_edge, low, left))]

    while True:
        near = _near(sums, names, edges, spans)
        if high <= low or near.limit(near_cuts + 1).count() <= near_cuts:
            break
        tried = sorted({low + (high - low) * i // (TRIES + 1) for i in range(TRIES + 1)} | {high})
        paths = _fill_many(sums, names, edges, tried, left)
        at = next(i for i, p in enumerate(paths) if p[-1] >= total)
        spans = list(zip(paths[max(0, at - 1)], paths[at], strict=True))
        low, high = tried[at - 1] + 1 if at else low, tried[at]
        if low == high:
            spans = [(p, p) for p in paths[at]]

    found = {edges[names.index(r.bucket)] + r.upto: r.text_key for r in near.collect()}
    ends = [0, *sorted(found)]
    floor = lambda x: ends[bisect_right(ends, x) - 1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fill(floor, mid, left)[-1] >= total else (mid + 1, high)
    return own, [found[p] for p in _even(ends, low, left, total)]


def _even(ends: list[int], capacity: int, shards: int, total: int) -> list[int]:
    """Cuts that keep to the capacity, each as near to its even share as it allows.

    The greedy fill gives the last place of each cut; filling from the right, the first.
    """
    first = [total]
    for _ in range(shards - 1):
        first.append(ends[bisect_left(ends, first[-1] - capacity)])
    first, out, at = first[::-1], [], 0
    for i in range(1, shards):
        share = total * i // shards
        j = bisect_right(ends, share)
        best = ends[j] if j < len(ends) and ends[j] - share < share - ends[j - 1] else ends[j - 1]
        at = min(max(best, first[i - 1]), ends[bisect_right(ends, at + capacity) - 1])
        out.append(at)
    return out


def _fill(floor, capacity: int, shards: int) -> list[int]:
    """Where each shard ends when it takes all that fits."""
    at, out = 0, []
    for _ in range(shards):
        at = floor(at + capacity)
        out.append(at)
    return out


def _near(sums: DataFrame, names: list[str], edges: list[int], spans: list[tuple[int, int]]) -> DataFrame:
    """The prefix sums inside spans (ends included)."""
    keep = F.lit(False)
    for p, q in spans:
        i, j = max(0, bisect_left(edges, p) - 1), min(len(names), bisect_right(edges, q)) - 1
        first, last = F.col("bucket") == names[i], F.col("bucket") == names[j]
        keep = keep | (F.col("bucket").between(names[i], names[j]) & (~first | (F.col("upto") >= p - edges[i]))
                       & (~last | (F.col("upto") <= q - edges[j])))
    return sums.filter(keep).select("bucket", "upto", "text_key")


def _fill_many(sums: DataFrame, names: list[str], edges: list[int], tried: list[int], shards: int) -> list[list[int]]:
    """``_fill`` for several capacities at once, one look into the stored prefix sums a shard."""
    at, paths = [0] * len(tried), [[] for _ in tried]
    for _ in range(shards):
        wanted = [min(p + c, edges[-1]) for p, c in zip(at, tried, strict=True)]
        of = [min(bisect_right(edges, x), len(names)) - 1 for x in wanted]
        points = sums.sparkSession.createDataFrame(
            [(i, names[b], x - edges[b]) for i, (b, x) in enumerate(zip(of, wanted, strict=True))],
            "i int, bucket string, x long")
        inside = {r.i: r.p for r in sums.join(F.broadcast(points), "bucket").filter("upto <= x")
                  .groupBy("i").agg(F.max("upto").alias("p")).collect()}
        at = [edges[b] + inside.get(i, 0) for i, b in enumerate(of)]
        for path, p in zip(paths, at, strict=True):
            path.append(p)
    return paths


def op1_minimax_shards(docs: DataFrame) -> DataFrame:
    """The digest of ``minimax_shards``: its law is ``bytes``, shard sizes as near equal as the groups allow."""
    return minimax_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
