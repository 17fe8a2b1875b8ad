"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint: the words taken from it shall sum to its
target.  Among all document rates between 0 and ``CAP`` that meet it, the one
of the highest entropy (of a rate r against its complement CAP - r) is an
exponential tilt of the document's size,

    r(size) = CAP / (1 + exp(-multiplier * size / scale)),

with one multiplier per source, the solution of the convex dual.  Newton steps
find it; a bracket guards each step, since rates saturate.  A document's rate
depends on its source and size only, so the steps run on counts of documents
by (source, size), pre-aggregated before the shuffle, however many rows a
source has.

Rates become copies by a deterministic draw from the hash of doc_id: the
whole part, and one more copy if the draw lies below the fraction.  ``PHASES``
shifts of the draws are summed in one aggregation per source, and each source
takes the shift whose words come nearest to its target.

Defined cases: a null text or one without words has size 0 and takes no
words.  A null source is a source of its own, after all others.  A source
without words has target 0.  Repeated rows have the same draw.  An empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import Store, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
PHASES = 64
#: Newton ends when every source's expected words are this near its target, relatively.
TOLERANCE = 1e-9
MAX_STEPS = 60


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies * size) of every row."""
    store = Store(docs.sparkSession, "mixing")
    sized = store.keep(_sized(docs, id_col, text_col, source_col), "sized")
    out = _with_copies(sized, *_plan(store, sized, weights, share))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as it has copies."""
    store = Store(docs.sparkSession, "mixing")
    sized = store.keep(_sized(docs, id_col, text_col, source_col), "sized")
    whole = _sized(docs, id_col, text_col, source_col, F.struct(*[docs[c] for c in docs.columns]).alias("m_row"))
    out = _with_copies(whole, *_plan(store, sized, weights, share))
    return out.select("m_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("m_row.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                       F.size(words(docs[text_col])).cast("long").alias("size"), *more)


def _plan(store: Store, sized: DataFrame, weights: tuple[float, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """The rate of each (source, size), and the phase of each source."""
    counts = store.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sources = store.keep(targets(counts, weights, share), "targets")
    solved = store.keep(_solve(store, counts, sources), "multipliers")
    rates = counts.join(solved, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("r_source"), F.col("size").alias("r_size"), "source_size", "target",
        _rate(F.col("size"), F.col("multiplier"), F.col("scale")).alias("rate"))
    rates = store.keep(rates, "rates")
    return rates, store.keep(_phases(_rated(sized, rates), solved), "phases")


def _rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")))
    return joined.drop("r_source", "r_size").withColumn(
        "draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53))


def _with_copies(rows: DataFrame, rates: DataFrame, phases: DataFrame) -> DataFrame:
    out = _rated(rows, rates).join(phases, F.col("source").eqNullSafe(F.col("p_source")))
    return out.withColumn("copies", _copies(F.col("rate"), F.col("draw"), F.col("phase")))


def targets(counts: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """One row per source: of, source_size, documents, largest, target.

    Sources by code point (null last) weigh ``weights`` in turn.  Together they
    get ``share`` of all words; what lies above CAP times a source's own words
    goes to the others by weight.  With sources ordered by words per weight, the
    full ones are a prefix, so running sums give the level at which it ends.
    """
    per = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                       F.sum("n").alias("documents"), F.max("size").alias("largest"))
    # Windows over one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(CAP))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), zero)
    weigh = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    per = per.withColumn("level", left / weigh)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("final", F.first(F.when(F.col("limit") > F.col("weight") * F.col("level"), F.col("level")),
                                          ignorenulls=True).over(whole))
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(
        F.least("limit", F.col("weight") * F.col("final")))
    return per.select(F.col("source").alias("of"), "source_size", "documents", "largest", target.alias("target"))


def _rate(size: Column, multiplier: Column, scale: Column) -> Column:
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -multiplier * size / scale))
    return F.lit(float(CAP)) / (F.lit(1.0) + F.exp(x))


def _solve(store: Store, counts: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with scale and multiplier, solved by Newton steps on the dual.

    Sizes are scaled by a source's mean.  At +-BOUND the rates of all documents of a
    word or more are at their limits, so the bracket holds the root.
    """
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.col("documents"))
    bound = scale * 60.0
    full = F.col("target") >= F.col("source_size") * float(CAP)  # every rate is CAP
    state = sources.select("*", scale.alias("scale"), F.when(full, bound).otherwise(0.0).alias("multiplier"),
                           F.when(full, bound).otherwise(-bound).alias("low"), bound.alias("high"),
                           F.lit(math.inf).alias("off"))
    for step in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        r = _rate(F.col("size"), F.col("multiplier"), F.col("scale"))
        words = F.col("n") * F.col("size")
        joined = counts.join(state.select("of", "multiplier", "scale"), F.col("source").eqNullSafe(F.col("of")))
        sums = joined.groupBy("of").agg(F.sum(words * r).alias("value"),
                                        F.sum(words * x * r * (1 - r / CAP)).alias("slope"))
        sums = sums.withColumnRenamed("of", "s_of")
        gap = F.col("target") - F.col("value")
        nxt = state.join(sums, F.col("of").eqNullSafe(F.col("s_of"))).drop("s_of")
        nxt = (nxt.withColumn("low", F.when(gap > 0, F.greatest("low", "multiplier")).otherwise(F.col("low")))
               .withColumn("high", F.when(gap < 0, F.least("high", "multiplier")).otherwise(F.col("high")))
               .withColumn("newton", F.col("multiplier") + gap / F.greatest(F.col("slope"), F.lit(1e-300)))
               .withColumn("off", F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        done = (F.col("off") <= TOLERANCE) | (F.col("low") >= F.col("high"))
        state = store.keep(nxt.withColumn("multiplier", F.when(done, F.col("multiplier")).when(inside, F.col("newton"))
                                          .otherwise((F.col("low") + F.col("high")) / 2)).drop("value", "slope", "newton"),
                           f"step-{step}")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    # The last digits of sums depend on the order of partial results; reruns must not.
    return state.select("of", "source_size", "target", F.round("multiplier", 7).alias("multiplier"),
                        F.round("scale", 7).alias("scale"))


def _copies(rate: Column, draw: Column, phase: Column) -> Column:
    shifted = draw + phase
    shifted = F.when(shifted >= 1, shifted - 1).otherwise(shifted)
    whole = F.floor(rate)
    return (whole + (shifted < rate - whole).cast("long")).cast("long")


def _phases(rated: DataFrame, solved: DataFrame) -> DataFrame:
    """The shift of the draws, per source, whose words come nearest to the target."""
    shifts = [i / PHASES for i in range(PHASES)]
    sums = rated.groupBy("source").agg(*[
        F.sum(F.col("size") * _copies(F.col("rate"), F.col("draw"), F.lit(s))).alias(f"w{i}")
        for i, s in enumerate(shifts)])
    options = F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")).alias("off"), F.lit(s).alias("phase"))
                        for i, s in enumerate(shifts)])
    return (sums.join(solved.select("of", "target"), F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("source").alias("p_source"), F.array_min(options)["phase"].alias("phase")))


def op5_entropy_mix(docs: DataFrame) -> DataFrame:
    """The digest of ``entropy_mix`` with the weights 3, 1, 2 and 150 % of all words."""
    return entropy_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
