"""What the two trained text models share: the training sample and its arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import work_folder
from flowlens.llm.textbatch import slices

#: Labelled documents that a model is fitted on, at most.
MOST_LABELLED = 20_000
#: Numbers, of all training texts together, that the driver holds, at most: whole texts, as many as fit.
MOST_NUMBERS = 12_000_000
#: Parts that a sample is stored in; numbers fetched at once.
PARTS, FETCHED = 128, 1_500_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column],
             most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text and label of at most ``most`` rows to learn from, in the order of a hash of the id.

    Rows without a label, an id or a text are left out; of repeated ids one row is.
    """
    wanted = labels.select(labels["doc_id"].alias("l_id"), labels[label].cast("int").alias("label"))
    wanted = (wanted.filter(F.col("label").isNotNull() & F.col("l_id").isNotNull() & learn(F.col("l_id")))
              .groupBy("l_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(most))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    # At most ``most`` rows of two numbers.
    return texts.join(F.broadcast(wanted), texts["doc_id"] == wanted["l_id"]).groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("label").alias("label"))


class Sample:
    """What ``features`` reads from the whole training texts (four-byte numbers), made on the executors and stored.

    The sample is dealt to PARTS parts by a hash of the id.  The driver holds the first parts whose numbers stay within
    ``most_numbers``, the first part in any case; it fetches FETCHED numbers at a time.  ``texts`` and ``labels`` stand in
    the order of part and id.
    """

    def __init__(self, sample: DataFrame, features: Callable[[], Callable[[str], np.ndarray]], name: str,
                 most_numbers: int = MOST_NUMBERS):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = features()
            for whole in batches:
                for batch in slices(whole):
                    found = [read(t) for t in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), batch.column(2), batch.column(3),
                         pa.array([len(f) for f in found], pa.int64())], ["doc_id", "f", "label", "part", "n"])

        kind = sample.schema["doc_id"].dataType.simpleString()
        sample = sample.select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"))
        schema = f"doc_id {kind}, f binary, label int, part int, n long"
        spark, path = sample.sparkSession, work_folder(sample.sparkSession, name)
        (sample.repartition(PARTS, "part").mapInArrow(run, schema).write.option("compression", "zstd")
         .partitionBy("part").parquet(path))
        stored = spark.read.schema(schema).parquet(path)
        sizes = sorted(tuple(r) for r in stored.groupBy("part").agg(F.sum("n")).collect())
        self.texts: list[np.ndarray] = []
        labels, at, total = [], 0, 0
        while at < len(sizes) and (not at or total + sizes[at][1] <= most_numbers):
            parts, fetched = [], 0
            while at < len(sizes) and (not at or total + sizes[at][1] <= most_numbers) and (not parts or fetched + sizes[at][1] <= FETCHED):
                parts.append(sizes[at][0])
                fetched += sizes[at][1]
                total += sizes[at][1]
                at += 1
            rows = stored.filter(F.col("part").isin(parts)).select("part", "doc_id", "f", "label").toArrow()
            rows = rows.sort_by([("part", "ascending"), ("doc_id", "ascending")])
            flat = np.frombuffer(b"".join(rows.column("f").to_pylist()), np.int32)
            ends = np.cumsum([len(f.as_py()) // 4 for f in rows.column("f")])
            self.texts += np.split(flat, ends[:-1])
            labels += rows.column("label").to_pylist()
            del rows
            pa.default_memory_pool().release_unused()
        self.labels = np.array(labels, np.float64)

    def batches(self, rng: np.random.Generator, size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """One pass over all texts in random order."""
        order = rng.permutation(len(self.texts))
        for at in range(0, len(order), size):
            rows = order[at:at + size]
            yield [self.texts[i] for i in rows], self.labels[rows]


def scores(docs: DataFrame, score: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """doc_id and score of every row; score gets the texts of a piece of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = score()
        for whole in batches:
            for batch in slices(whole):
                out = read([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(out, np.float64))],
                                                 ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

