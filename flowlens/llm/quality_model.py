"""Quality by supervised subword embeddings.

A text's features are its words, its word pairs and the character 3- and 4-grams of its words (with
``<`` and ``>`` as word ends), hashed to ``BUCKETS`` rows of an embedding of ``DIM`` numbers.  A word's vector
is the mean of its own and its character n-grams' rows; a document is the mean of its words'
and word pairs' vectors; a softmax of two outputs follows.  Embedding and output are learned
together from labels by stochastic gradient descent in numpy, with a falling rate.

Only labels are learned from, of at most ``MOST_LABELLED`` documents and of those as many as ``learning.MOST_NUMBERS``
numbers hold: their whole texts are read to sparse counts on the executors, stored, and fetched once.  The model is a
fixed ``BUCKETS`` * ``DIM`` numbers; every whole text is scored by the executors, with all n-grams of all words.

Defined cases: a null or empty text has no words; its vector is zero and its score the
output's bias.  Null labels are not learned from.  Without labels, or with one label only,
the score is the share of label 1 (a half without any).  Repeated rows get equal scores; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.learning import Sample, fold, labelled, scores
from flowlens.llm.textbatch import split, windows

BUCKETS, DIM = 1 << 17, 12
GRAMS = (3, 4)
#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 8_000
#: Passes over the sample; more over a small one, for LEAST_STEPS batches at least.
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 1200, 32, 0.4
#: Words, and characters of words, that a task remembers; n-grams whose rows are read at once.
REMEMBERED, REMEMBERED_CHARS, PIECE = 300_000, 8_000_000, 100_000
THRESHOLD = 0.7
PAIR = np.uint64(0x9E3779B97F4A7C15)


def place(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


SAME = place("= =")


def features(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words' own rows and, per n, the rows of all their n-grams in order and the word that owns each."""
    own = np.fromiter(map(place, words), np.int64, len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner, last = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    grams = []
    for n in GRAMS:
        inside = np.flatnonzero(np.arange(len(codes)) + n <= last)
        rows = (windows(codes, n) + np.uint64(n))[inside] % np.uint64(BUCKETS) if len(inside) else np.empty(0, np.uint64)
        grams.append((rows.astype(np.int32), owner[inside]))
    return own, grams


def pairs(ids: np.ndarray) -> np.ndarray:
    """Rows of neighbouring words, from their own rows; a word and itself again have the row SAME, whichever it is."""
    x = ids.astype(np.uint64)
    rows = (((x[:-1] * PAIR + x[1:]) * PAIR >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    return np.where(x[:-1] == x[1:], SAME, rows)


def reader():
    """Reads a whole training text to its distinct features' rows and, as the same bytes, what each adds to its mean."""
    def read(text: str) -> np.ndarray:
        words = split(text)
        if not words:
            return np.empty(0, np.int32)
        counts = Counter(words)
        own, grams = features(list(counts))
        share = np.fromiter(counts.values(), np.float64, len(own)) / (1 + sum(np.bincount(o, minlength=len(own)) for _, o in grams))
        number = dict(zip(counts, range(len(own)), strict=True))
        two = pairs(own[np.fromiter(map(number.__getitem__, words), np.int64, len(words))])
        rows, at = np.unique(np.concatenate([own, *(r for r, _ in grams), two]), return_inverse=True)
        weight = np.concatenate([share, *(share[o] for _, o in grams), np.ones(len(two))])
        weight = np.bincount(at, weight) / (2 * len(words) - 1)
        return np.concatenate([rows.astype(np.int32), weight.astype(np.float32).view(np.int32)])
    return read


def weighted(read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a training text's features and what each adds to its mean."""
    n = len(read) // 2
    return read[:n], read[n:].view(np.float32)


class Model:
    def __init__(self, share: float = 0.5):
        self.rows = np.random.default_rng(11).uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((2, DIM), np.float32)
        self.bias = np.log(np.array([1 - share + 1e-3, share + 1e-3], np.float32))
        self.fixed: float | None = None

    def softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.out.T + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(sample: Sample) -> Model:
    """sample: texts as ``reader`` reads them."""
    labels = sample.labels
    share = float(labels.mean()) if len(labels) else 0.5
    m = Model(share)
    if not len(labels) or share in (0.0, 1.0):
        m.fixed = share
        return m
    batches = -(-len(labels) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    rng, step, steps = np.random.default_rng(13), 0, epochs * batches
    at_row = np.zeros(BUCKETS, np.int64)
    for _ in range(epochs):
        for texts, y in sample.batches(rng, BATCH):
            rate = RATE * max(0, 1 - step / steps)
            step += 1
            part, y = [weighted(t) for t in texts], y.astype(int)
            rows = np.concatenate([r for r, _ in part])
            if not len(rows):
                continue
            here = np.zeros(BUCKETS, bool)
            here[rows] = True
            known = np.flatnonzero(here)
            at_row[known] = np.arange(len(known))
            # A text's rows are distinct: one place of the batch's matrix each.
            share_of = np.zeros((len(part), len(known)), np.float32)
            share_of[np.repeat(np.arange(len(part)), [len(r) for r, _ in part]), at_row[rows]] = np.concatenate([w for _, w in part])
            x = share_of @ m.rows[known]
            off = m.softmax(x)
            off[np.arange(len(y)), y] -= 1
            dx = off @ m.out
            m.out -= (rate * off.T @ x).astype(np.float32)
            m.bias -= (0.1 * rate / len(y) * off.sum(0)).astype(np.float32)
            m.rows[known] -= (rate * share_of.T @ dx).astype(np.float32)
    return m


class Vectors(dict):
    """Words' vectors and own rows under a model, remembered within a bound."""

    def __init__(self, rows: np.ndarray):
        super().__init__()
        self.rows, self.table, self.own = rows, np.empty((REMEMBERED, DIM), np.float32), np.empty(REMEMBERED, np.int64)
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        own, grams = features(words)
        total, sizes = self.rows[own].astype(np.float64), np.ones(len(words))
        for rows, owner in grams:
            sizes += np.bincount(owner, minlength=len(words))
            for at in range(0, len(rows), PIECE):
                o = owner[at:at + PIECE]
                first = np.flatnonzero(np.diff(o, prepend=-1))
                total[o[first]] += np.add.reduceat(self.rows[rows[at:at + PIECE]], first)
        i = len(self) + np.arange(len(words))
        self.table[i], self.own[i] = total / sizes[:, None], own
        self.update(zip(words, i.tolist(), strict=True))

    def document(self, words: list[str]) -> np.ndarray:
        total, last = np.zeros(DIM), None
        for at in range(0, len(words), REMEMBERED // 2):
            part = words[at:at + REMEMBERED // 2]
            if len(self) + len(part) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.clear()
                self.chars = 0
            new = [w for w in dict.fromkeys(part) if w not in self]
            if new:
                self.chars += sum(map(len, new))
                self.learn(new)
            i = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            own = self.own[i] if last is None else np.append(last, self.own[i])
            total += self.table[i].sum(0) + self.rows[pairs(own)].sum(0)
            last = own[-1]
        return total / max(1, 2 * len(words) - 1)


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    held_out = lambda c: fold(c, 4) == 2
    sample = labelled(docs, labels, "quality", lambda c: ~held_out(c), most)
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(Sample(sample, reader, "quality-sample"))))

    def score():
        m = Model.__new__(Model)
        vars(m).update(model.value)
        if m.fixed is not None:
            return lambda texts: np.full(len(texts), m.fixed)
        vectors = Vectors(m.rows)
        return lambda texts: m.softmax(np.array([vectors.document(split(t)) for t in texts]))[:, 1]

    out = scores(docs, score)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_subword_embeddings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels)
