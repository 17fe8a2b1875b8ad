"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to ``TERMS`` places, each with the value 1: its lower-cased words
(runs of letters) and the beginnings of longer ones (``STEMS`` letters), which inflected forms share.  The score is the logistic of

    bias + sum_i w_i + c (|sum_i v_i|^2 - sum_i |v_i|^2) / 2,     c = min(1, ``USUAL`` / terms),

the last part being the sum of <v_i, v_j> over all pairs of terms: what an insult adds
beside the mention of a group is learned, which additive weights cannot tell.  c gives the pairs of a long
text, whose number grows with the square of its terms, the spread that those of ``USUAL`` terms have.  Fitted in
numpy on mini-batches.  Both parts are sparse: w follows FTRL-proximal steps, where a term's summed gradient must
exceed what chance gives a term of its frequency; after ``ALONE`` passes v joins in for every known term, whatever
its w, and its rows are pulled to zero as a whole (``LV``).  Known terms are those of ``LEAST_TEXTS`` training texts;
others say nothing and are left out of a text.

Only labels are learned from, of at most ``MOST_LABELLED`` documents, read whole, and of those as many as
``learning.MOST_NUMBERS`` terms hold.  The model is a
fixed ``TERMS`` * (1 + ``FACTORS``) numbers; every whole text is scored by the executors.

Defined cases: a null or empty text has no terms and its score is the logistic of the
bias.  Null labels are not learned from.  Without labels, or with one label only, the
score is the share of label 1 (a half without any).  Repeated rows get equal scores; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.learning import MOST_LABELLED, Sample, fold, labelled, scores

TERMS = 1 << 18
FACTORS = 4
EPOCHS, ALONE, BATCH = 16, 2, 64
RATE, RATE_V, L1, L2, LV, START_V, USUAL = 1.0, 0.2, 2.0, 0.01, 0.02, 0.1, 20
#: Terms of fewer training texts say nothing.
LEAST_TEXTS = 5
STEMS = (4, 6)
TERM_RE = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000
THRESHOLD = 0.7


class Places(dict):
    """Hashed places of terms, remembered within a bound."""

    def __missing__(self, term: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[term] = p = xxhash.xxh3_64_intdigest(term) % TERMS
        return p


def reader():
    seen = Places()

    def read(text: str) -> np.ndarray:
        words = set(TERM_RE.findall(text.lower()))
        terms = words.union(w[:n] + "-" for n in STEMS for w in words if len(w) > n)
        return np.unique(np.fromiter(map(seen.__getitem__, terms), np.int32, len(terms)))
    return read


def scale(sizes: np.ndarray) -> np.ndarray:
    """c of texts of so many terms."""
    return np.minimum(1, USUAL / np.maximum(sizes, 1))


class Machine:
    """bias, w and v of a factorization machine."""

    def __init__(self, share: float):
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        self.w = np.zeros(TERMS, np.float32)
        self.v = np.zeros((TERMS, FACTORS), np.float32)
        self.known = np.ones(TERMS, bool)

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        texts = [t[self.known[t]] for t in texts]
        some = [i for i, t in enumerate(texts) if len(t)]
        if some:
            flat = np.concatenate([texts[i] for i in some])
            starts = np.cumsum([0] + [len(texts[i]) for i in some[:-1]])
            v = self.v[flat]
            sums = np.add.reduceat(v, starts)
            out[some] += np.add.reduceat(self.w[flat], starts) + 0.5 * scale(np.array([len(texts[i]) for i in some])) * (
                (sums ** 2).sum(1) - np.add.reduceat((v ** 2).sum(1), starts))
        return out

    def probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    share = float(labels.mean()) if len(labels) else 0.5
    m = Machine(share)
    if share in (0.0, 1.0) or not len(labels):
        m.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return m
    df = np.bincount(np.concatenate(texts), minlength=TERMS)
    m.known = df >= LEAST_TEXTS
    texts = [t[m.known[t]] for t in texts]
    rng = np.random.default_rng(7)
    gw, gv, gb = np.zeros(TERMS), np.ones(TERMS), 1.0
    pull, base = np.zeros(TERMS), m.bias
    for epoch in range(epochs):
        if epoch == ALONE:
            known = np.flatnonzero(m.known)
            m.v[known] = rng.normal(0, START_V, (len(known), FACTORS))
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            part = [texts[i] for i in rows]
            off = m.probabilities(part) - labels[rows]
            gb += off.sum() ** 2
            m.bias -= RATE * (off.sum() + 0.1 * (m.bias - base)) / np.sqrt(gb)
            sizes = np.array([len(p) for p in part])
            if not sizes.sum():
                continue
            flat = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), sizes)
            places, inverse = np.unique(flat, return_inverse=True)
            # FTRL-proximal for w: zero until a term's summed gradient exceeds L1.
            dw = np.bincount(inverse, off[owner], len(places))
            grown = np.sqrt(gw[places] + dw ** 2)
            pull[places] += dw - (grown - np.sqrt(gw[places])) / RATE * m.w[places]
            gw[places] = grown ** 2
            z, need = pull[places], L1 * np.sqrt(df[places])
            m.w[places] = np.where(np.abs(z) <= need, 0, -(z - np.sign(z) * need) / ((1 + grown) / RATE + L2))
            # AdaGrad for v, with a pull of the whole row to zero, which it leaves again at a steeper gradient.
            if epoch < ALONE:
                continue
            v = m.v[flat]
            sums = np.stack([np.bincount(owner, v[:, f], len(part)) for f in range(FACTORS)], 1)
            dv = (off * scale(sizes))[owner, None] * (sums[owner] - v)
            dv = np.stack([np.bincount(inverse, dv[:, f], len(places)) for f in range(FACTORS)], 1)
            gv[places] += (dv ** 2).sum(1)
            step = RATE_V / np.sqrt(gv[places])
            v = m.v[places] - step[:, None] * dv
            norm = np.sqrt((v ** 2).sum(1)) + 1e-12
            m.v[places] = v * np.maximum(0, 1 - step * LV / norm)[:, None]
    return m


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    held_out = lambda c: fold(c, 3) == 1
    sample = labelled(docs, labels, "toxic", lambda c: ~held_out(c), most)
    sample = Sample(sample, reader, "toxicity-sample")
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(sample.texts, sample.labels)))

    def score():
        read, machine = reader(), Machine.__new__(Machine)
        vars(machine).update(model.value)
        return lambda texts: machine.probabilities([read(t) for t in texts])

    out = scores(docs, score)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_factorization_machine(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, labels)
