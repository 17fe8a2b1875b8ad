"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, with byte-level BPE; nothing is trained.  The
tokens' byte lengths give each token's span in the text's UTF-8 bytes.  Sections (here a
document's lines, a line holding its own line end) are spans of the same bytes, so
one sorted merge of the two interval lists counts the tokens of every section.

A token that crosses a section's boundary is allocated by ``rule``:
  first   to the section that holds its first byte (the default),
  most    to the section that holds most of its bytes, the earlier one if equal,
  split   to each section, by its share of bytes (fractions of tokens).
Under each rule a document's sections sum to its tokens.

Defined cases: a null text has no sections and no row; the empty text has one section of
no tokens.  A last line without characters (a text that ends in a line end) is no
section.  Strings that look like control tokens are ordinary text.  Repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textbatch import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published split of a text into pieces; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "most", "split")
#: A run of white space of so many characters or more is encoded apart from the pattern, which would overflow on it.
LONG_BLANK = 10_000
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)


def encoder(vocabulary: str):
    """(encode, bytes of each token id)."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in BLANKS.finditer(text):
            # The pattern cuts a run before its last blank, which may belong to what follows; at the text's end it takes all.
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += bpe.encode_ordinary(text[at:run.start()])
            out += bpe._encode_single_piece(text[run.start():end])
            at = end
        return out + bpe.encode_ordinary(text[at:])
    return encode, size


def line_ends(data: bytes) -> np.ndarray:
    """Where each section ends, in bytes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; both lists of ends are sorted and end at the same byte."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    if rule == "first":
        return np.bincount(first, minlength=len(section_ends))
    last = np.searchsorted(section_ends, token_ends, side="left")
    out = np.zeros(len(section_ends), np.float64)
    np.add.at(out, first[first == last], 1)
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[starts[i]], section_ends[first[i]:last[i]], [token_ends[i]]])
        parts = np.diff(cuts)
        if rule == "most":
            out[first[i] + int(parts.argmax())] += 1
        else:
            out[first[i]:last[i] + 1] += parts / parts.sum()
    return out


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), byte_start, byte_end and n_tokens of every section of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole):
                ends, counts, sections = [], [], []
                for text in batch.column(1).to_pylist():
                    data = text.encode()
                    e = line_ends(data)
                    tokens = np.array(encode(text), np.int64)
                    counts.append(attribute(np.cumsum(size[tokens]), e, rule) if len(tokens) else np.zeros(len(e)))
                    ends.append(e)
                    sections.append(len(e))
                if not sections:
                    continue
                owner = np.repeat(np.arange(len(sections)), sections)
                stop = np.concatenate(ends)
                start = np.concatenate([np.concatenate([[0], e[:-1]]) for e in ends])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(owner)), pa.array(np.concatenate([np.arange(n) for n in sections])),
                    pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)),
                    pa.array(np.concatenate(counts).astype(np.float64))],
                    ["doc_id", "section", "byte_start", "byte_end", "n_tokens"])

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(run, f"doc_id {kind}, section long, byte_start long, byte_end long, n_tokens double")


def op10_section_tokens(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every document; a token that crosses a line's end counts where it begins."""
    return section_tokens(docs).withColumn("n_tokens", F.col("n_tokens").cast("long"))
