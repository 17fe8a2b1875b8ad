"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Texts are lower-cased; white space and ASCII punctuation stand between words.
Document windows begin at every ``STEP``-th word, item windows at every word.
They are not item-sized: one size serves all items, set by the shortest run of words
that ``SIMILARITY`` leaves unchanged in any of them (``unchanged``), as many whole steps
as such a run holds wherever it stands (12 words at most).  So every leak holds a
document window whose fingerprint some item window has too.  A fingerprint takes, for each
bit, the majority of its words' hash bits, counted on 15 four-bit lanes per long
and added piece by piece; a document costs a few array passes and no shuffle.

The fingerprints of item windows (probes) are split into ``RADIUS`` + 1 blocks.  By
the pigeonhole principle a document window within ``RADIUS`` bits of a probe equals
it in one block at least, so looking up the blocks finds all of them.  A bitmap of
the probes' block values, of a fixed size, lets most windows drop before the join;
it holds back none that could match.

A match proposes where the item would start.  The words there, as many as the item
has, are compared with the item by weighted Jaccard similarity of five-word
shingles (weight: how often a shingle occurs); ``SIMILARITY`` or more is a leak.

Defined cases: null and empty texts, and items of fewer than five words, match
nothing.  Rows with a null doc_id cannot be named and are not reported.  Rows that
share a doc_id are one document, the best match counts.  Items with equal texts
are each reported.  An empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Store

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 1
STEP = 4
#: Windows have 12 words at most; a lane counts to 15.
LARGEST, LANES = 12, 15
#: Bits of bitmap per block, by planes; primes, since a block's value is taken modulo them.
BITMAP = {3: 1_048_573, 4: 4_194_301}
#: White space and ASCII punctuation stand between words.
BETWEEN = r"[\x00-\x20!-/:-@\[-`{-~]+"


def _normal(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _lanes(bit: int) -> int:
    """Bit ``bit`` of every lane."""
    return sum(1 << (4 * lane + bit) for lane in range(LANES))


def fingerprints(df: DataFrame, size: int, step: int, planes: int) -> DataFrame:
    """df with ``s_f``: fingerprints of the windows of ``size`` words of the array ``s_w`` that begin at every ``step``-th
    word, in order; ``size`` is a multiple of ``step``.

    Plane k counts bits k, k + 4, ... of the words' hashes.
    """
    df = df.withColumn("s_h", F.transform("s_w", lambda w: F.xxhash64(w)))
    pieces, many = F.size("s_w") / step, size // step

    def piece(k: int) -> Column:
        def counted(j: Column) -> Column:
            out = None
            for t in range(step):
                bits = F.shiftright(F.get("s_h", j * step + t), k).bitwiseAND(F.lit(_lanes(0)))
                out = bits if out is None else out + bits
            return out
        return F.transform(F.sequence(F.lit(0), F.floor(pieces).cast("int") - 1), counted)

    df = df.filter(F.size("s_w") >= size).withColumns({f"s_{k}": piece(k) for k in range(planes)})
    most = size // 2 + 1  # a majority
    lift = sum((8 - most) << (4 * lane) for lane in range(LANES))
    length = F.size("s_0") - many + 1

    def total(k: int) -> Column:
        out = F.slice(f"s_{k}", 1, length)
        for j in range(1, many):
            out = F.zip_with(out, F.slice(f"s_{k}", j + 1, length), lambda x, y: x + y)
        return out

    def majority(x: Column, k: int) -> Column:
        x = x + F.lit(lift) if lift else x
        return F.shiftright(x.bitwiseAND(F.lit(_lanes(3))), 3 - k)

    df = df.withColumns({f"s_t{k}": total(k) for k in range(planes)})
    prints = F.transform("s_t0", lambda x: majority(x, 0))
    for k in range(1, planes):
        prints = _merged(prints, F.col(f"s_t{k}"), k, majority)
    return df.withColumn("s_f", prints).drop("s_h", *[f"s_{k}" for k in range(planes)],
                                             *[f"s_t{k}" for k in range(planes)])


def _merged(prints: Column, totals: Column, k: int, majority) -> Column:
    return F.zip_with(prints, totals, lambda f, x: f.bitwiseOR(majority(x, k)))


def _blocks(f: Column) -> list[Column]:
    """The fingerprint's lanes, dealt to RADIUS + 1 blocks."""
    cuts = [round(LANES * b / (RADIUS + 1)) for b in range(RADIUS + 2)]
    return [F.shiftright(f, 4 * lo).bitwiseAND(F.lit((1 << 4 * (hi - lo)) - 1))
            for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _shingles(w: Column) -> Column:
    return F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _numbered(shingles: str) -> Column:
    """Equal shingles made distinct by their count so far, so that set sizes are sums of weights."""
    return F.transform(shingles, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(F.col(shingles), x)))


def unchanged(n_words: int, similarity: float = SIMILARITY) -> int:
    """Words of the longest unchanged run, at least, of an item of ``n_words`` in a passage of that similarity.

    Of the item's shingles ``lost`` are not in the passage, ``more`` of the passage's are not in the item, and
    lost + similarity * more <= (1 - similarity) * shingles.  Words changed or cut at the edges lose a shingle each,
    and cut by the document's end they bring no other; a break within the item loses four shingles and brings four.
    """
    shingles = n_words - SHINGLE + 1
    left, least = (1 - similarity) * shingles + 1e-9, n_words
    for breaks in range(int(left / ((SHINGLE - 1) * (1 + similarity))) + 1):
        lost = int(left - similarity * (SHINGLE - 1) * breaks)
        least = min(least, -(-(shingles - lost) // (breaks + 1)) + SHINGLE - 1)
    return least


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words (of the item) of every item found in a document."""
    spark = docs.sparkSession
    store = Store(spark, "decontam")
    named = store.keep(benchmark.select(benchmark[item_col].alias("item_id"), _normal(benchmark[item_text]).alias("s_w"))
                       .filter(F.size("s_w") >= SHINGLE)
                       .withColumn("item_key", F.sha2(F.array_join("s_w", " "), 256)), "items")
    items = named.select("item_key", "s_w").dropDuplicates(["item_key"])
    run = min((unchanged(r[0], similarity) for r in named.select(F.size("s_w")).distinct().collect()), default=None)
    if run is None:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int").select(
            F.col("doc_id").cast(docs.schema[id_col].dataType), F.col("item_id").cast(benchmark.schema[item_col].dataType),
            "similarity", "start", "n_words")
    step = STEP if run >= 3 * STEP - 1 else 1
    size = min(LARGEST, run - step + 1) // step * step
    many = named.agg(F.sum(F.size("s_w"))).first()[0]
    planes = 3 if many <= 2**16 else 4
    probes = fingerprints(items, size, 1, planes).select(
        "item_key", F.size("s_w").alias("n_words"), F.posexplode("s_f").alias("at", "probe"))
    probes = probes.withColumn("b", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_blocks(F.col("probe")))])))
    probes = store.keep(probes.select("item_key", "n_words", "at", "probe", "b.block", "b.value"), "probes")

    bits = BITMAP[planes]
    place = F.col("value") % bits
    maps: dict[int, dict[int, int]] = {i: {} for i in range(RADIUS + 1)}
    for r in (probes.select("block", F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit"))
              .groupBy("block", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("m")).collect()):
        maps[r.block][r.word] = r.m
    bitmaps = [F.expr("array(" + ",".join(f"{m.get(w, 0)}L" if m.get(w, 0) > -(2**63) else "-9223372036854775807L - 1L"
                                          for w in range(bits // 64 + 1)) + ")") for m in maps.values()]

    def possible(f: Column) -> Column:
        found = F.lit(False)
        for bitmap, value in zip(bitmaps, _blocks(f), strict=True):
            place = value % bits
            word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
            found = found | (F.bit_get(word, (place % 64).cast("int")) == 1)
        return found

    windows = fingerprints(docs.filter(docs[id_col].isNotNull()).select(
        docs[id_col].alias("doc_id"), _normal(docs[text_col]).alias("s_w")), size, step, planes)
    hits = F.array_compact(F.transform("s_f", lambda f, i: F.when(possible(f), F.struct(f.alias("f"), (i * step).alias("pos")))))
    windows = windows.select("doc_id", F.inline(hits))
    windows = windows.select("doc_id", "f", "pos", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), v.alias("value"))
        for i, v in enumerate(_blocks(F.col("f")))])).alias("b")).select("doc_id", "f", "pos", "b.*")
    near = windows.join(probes, ["block", "value"]).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("probe"))) <= RADIUS)
    spans = store.keep(near.select("doc_id", "item_key", (F.col("pos") - F.col("at")).alias("start"), "n_words")
                       .distinct(), "candidates")

    # A document's words are made once, however many spans it has.
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("item_key", "start", "n_words")).alias("spans"))
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("d_text"))
    pairs = spans.join(texts, "doc_id").withColumn("d_w", _normal(F.col("d_text"))).drop("d_text")
    there = F.transform("spans", lambda x: F.struct(
        x["item_key"].alias("item_key"), x["start"].alias("start"), x["n_words"].alias("n_words"),
        F.slice("d_w", F.greatest(x["start"], F.lit(0)) + 1,
                x["n_words"] + F.least(x["start"], F.lit(0))).alias("d_v")))
    pairs = pairs.withColumn("there", there).filter(F.size("d_w") > 0).select("doc_id", F.inline("there"))
    pairs = pairs.withColumn("d_s", _shingles(F.col("d_v"))).drop("d_v")
    pairs = pairs.withColumn("d_s", _numbered("d_s"))
    of_items = items.select("item_key", _shingles(F.col("s_w")).alias("i_s")).withColumn("i_s", _numbered("i_s"))
    both = F.size(F.array_intersect("d_s", "i_s"))
    pairs = pairs.join(of_items, "item_key").withColumn("both", both).withColumn(
        "similarity", F.col("both") / (F.size("d_s") + F.size("i_s") - F.col("both")))
    best = (pairs.filter(F.col("similarity") >= similarity)
            .groupBy("doc_id", "item_key").agg(
                F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("best")))
    return best.join(named.select("item_id", "item_key"), "item_key").select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("int").alias("start"),
        F.col("best.n_words").cast("int").alias("n_words"))


def op3_simhash_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).withColumn("similarity", F.round("similarity", 9))
